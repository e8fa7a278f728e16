import json

import pytest
from pyspark.sql import functions as F

from skriva.functions import scoring, text
from skriva.operators import blocked, neardup, orphans, search, select, snapshots, vectors, workspace
from skriva.operators.sessions import clean_turns, command_blocks, episodes
from skriva.sources import markdown, state, transcripts
from skriva.streaming import telemetry as streams


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_tokens_and_terms(spark):
    assert one(spark, text.estimate_tokens(F.lit("abcde"))) == 2
    assert one(spark, text.estimate_tokens(F.lit("設計ab"))) == 3
    assert one(spark, text.estimate_tokens(F.lit(None).cast("string"))) == 0
    assert one(spark, text.query_terms(F.lit(' alpha" OR　NEAR(a b) '))) == ["alpha", "OR", "NEAR", "a", "b"]
    assert one(spark, text.cjk_windows(F.lit("依存を増やさない"))) == ["依存を増やさない", "依存を増", "を増やさ", "やさない"]
    assert one(spark, text.shingles(F.lit("AB  cd"))) == ["ab cd"]


def test_within_tokens(spark):
    texts = [None, "", "a" * 12, "a" * 13, "設計検", "設計検索", "設計a", "設a", "é" * 12, "é" * 13, " " * 13, "設" + "a" * 8, "設" + "a" * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", text.within_tokens(F.col("t"), 3).alias("w"), text.estimate_tokens(F.col("t")).alias("n")).collect()
    assert all(r.w == (r.n <= 3) for r in rows) and {r.w for r in rows} == {True, False}


def test_interesting_lines(spark):
    out = "ok\n  E   assert 1 == 2\nE   where x\nSEE   nothing\n3 passed\n3 passed\nfine\nFile not found: no such file\nTheme   x"
    assert one(spark, text.interesting_lines(F.lit(out))) == ["E   assert 1 == 2", "E   where x", "3 passed", "File not found: no such file"]
    assert one(spark, text.interesting_lines(F.lit("error in node_modules/x"))) == []
    assert one(spark, text.interesting_lines(F.lit(None).cast("string"))) == []


def test_redact_keeps_code_and_short_values(spark):
    assert one(spark, text.redact(F.lit('API_KEY="abcdefghij" x'))) == 'API_KEY="[redacted]" x'
    assert one(spark, text.redact(F.lit("PASSWORD=short"))) == "PASSWORD=short"
    assert one(spark, text.redact(F.lit("a <private>b</private> c"))) == "a [redacted] c"
    assert one(spark, text.redact(F.lit("ghp_" + "a1" * 15))) == "[redacted]"


def test_paths(spark):
    assert one(spark, text.indexable(F.lit("private-x/a.md"), [], ["private"])) is True
    assert one(spark, text.indexable(F.lit("journal/sessions/a.md"))) is False
    assert one(spark, text.project_of(F.lit("work/alpha/x.md"), F.lit(None).cast("string"), ["work"])) == "alpha"
    assert one(spark, text.project_of(F.lit("alpha/x.md"), F.lit(""))) == ""


def test_scores(spark):
    assert one(spark, scoring.overlapping_count(F.lit("aaaaaa"), F.lit("aaa"))) == 4
    assert one(spark, scoring.overlapping_count(F.lit(r"a\E.a\E."), F.lit(r"\E."))) == 2
    assert one(spark, scoring.usage_score(F.lit(20), F.lit(0.0), F.lit(1), 1.0)) == 1.0
    assert one(spark, scoring.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0)))) == 0.0


def test_chunks_keep_structures_whole():
    body = "# A\n## B\n## C\ntext\n\n```bash\n# no heading\n```"
    assert [(a, t) for a, t, _ in markdown.chunk_body(body)] == [("A / C", "text\n\n```bash\n# no heading\n```")]
    fence = "```python\n" + "\n".join(f"x = {i}" for i in range(400)) + "\n```"
    assert len(markdown.chunk_body(fence, 50, 0)) == 1
    parts = markdown.chunk_body("\n".join("認証の設計を確認した" for _ in range(300)), 60, 10)
    assert len(parts) > 5 and all(t <= 80 for *_, t in parts)
    assert markdown.chunk_body(None) == []


def test_front_matter_and_scan(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a b.md").write_text("---\ntitle: A\ntitle: B\ntags: [x, 'y']\nproject:\n---\n\n# H\n\n[[T|alias]] [[S#x]] [[T]]\n")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "c.md").write_text("no")
    (tmp_path / "d.md").write_text("---\nunclosed\n")
    rows = {r["path"]: r for r in markdown.parse_notes(markdown.scan_notes(spark, str(tmp_path))).collect()}
    assert set(rows) == {"p/a b.md", "d.md"}
    a = rows["p/a b.md"]
    assert (a["title"], a["tags"], a["links"], a["project"]) == ("B", ["x", "y"], ["S", "T"], "")
    assert rows["d.md"]["title"] == "d" and rows["d.md"]["body"].startswith("---")


def test_search_and_selection(spark):
    p = spark.createDataFrame(
        [(1, "Firebase auth", "", "", "認証 設計 Firebase notes", 5, "a.md", "", "durable"), (2, "t", "", "", "設計 only here", 5, "b.md", "x", "durable"), (3, "", "", "", "", None, "c.md", None, None)],
        "chunk_id bigint, title string, tags string, breadcrumb string, body string, tokens int, path string, project string, tier string",
    )
    q = spark.createDataFrame([(1, "firebase notes"), (2, '" * ( ) ^ -'), (3, None), (4, "認証")], "query_id bigint, text string")
    got = {(r.query_id, r.label, r.chunk_id) for r in search.keyword_rankings(p, q, 20).collect()}
    assert got == {(1, "all-terms", 1), (1, "keyword", 1)}
    sub = search.substring_ranking(p, q, 20).collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in sub] == [(4, 1, 1.0)]
    kept = select.choose([(1, 50, "a" * 40), (2, 50, "a" * 40), (3, 80, "b"), (4, 10, "c")], 8, 90)
    assert kept == ([1, 4], 60, 0, 2)
    long = "the same sentence about the same cache in two places"
    assert select.choose([(1, 1, long), (2, 1, long)], 8, 10) == ([1], 1, 1, 0)


def test_rankings_match_brute_force_in_small_blocks(spark, monkeypatch):
    import math
    import random

    from skriva.operators import postings

    for name, value in {"ROW_DOCS": 16, "BLOCK_POSTINGS": 60, "BLOCK_DOCS": 40}.items():
        monkeypatch.setattr(postings, name, value)
    monkeypatch.setattr(search, "BLOCK_CHARS", 12)
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    # Id 7 stands in two passages, of which one is in the scope.
    rows = [(i, "", "", "", " ".join(r.choices(words, k=r.randint(1, 5))), 5, "x" if i % 3 else "y") for i in range(120)] + [(7, "", "", "", "zeta alpha", 5, "y")]
    p = spark.createDataFrame(rows, "chunk_id bigint, title string, tags string, breadcrumb string, body string, tokens int, project string").repartition(3)
    asked = {1: "alpha", 2: "beta gamma", 3: "zeta alpha delta", 4: "gamma BETA", 5: None}
    q = spark.createDataFrame(list(asked.items()), "query_id bigint, text string")
    mean = sum(max(0, len(x[4]) - 2) for x in rows) / len(rows)
    idf = {w: max(math.log((len(rows) - n + 0.5) / (n + 0.5)), 0) or 1e-6 for w in words for n in [sum(w in x[4] for x in rows)]}
    part = lambda w, x: -idf[w] * x[4].count(w) * 2.2 / (x[4].count(w) + 1.2 * (0.25 + 0.75 * max(0, len(x[4]) - 2) / mean))
    for scope in (None, "y"):
        want = set()
        seen = {x[0] for x in rows if scope in (None, x[6])}
        for i, text in asked.items():
            terms = set((text or "").lower().split())
            held = {c: [(w, x) for x in rows if x[0] == c for w in terms if w in x[4]] for c in seen}
            scores = sorted((round(sum(part(w, x) for w, x in h), 6), c) for c, h in held.items() if h)
            want |= {(i, "keyword", k + 1, c, s) for k, (s, c) in enumerate(scores[:20])}
            full = [x for x in scores if len(held[x[1]]) == len(terms) > 1]
            want |= {(i, "all-terms", k + 1, c, s) for k, (s, c) in enumerate(full[:20])}
        got = [tuple(x) for x in search.keyword_rankings(p, q, 20, None if scope is None else F.col("project") == scope).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_rankings_write_no_pairs(spark):
    """What is written grows with the passages, not with the queries times the passages."""
    import os

    from skriva.session import shared_folder

    d = shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(a, f)) for a, _, fs in os.walk(d) for f in fs)
    p = spark.range(5000).selectExpr("id AS chunk_id", "'' AS title", "'' AS tags", "'' AS breadcrumb", "concat('common words ', id) AS body", "1 AS tokens", "'' AS project")
    q = spark.range(300).selectExpr("id AS query_id", "concat('common words ', id, ' of query') AS text")
    before = size()
    assert search.keyword_rankings(p, q, 20, labels=("keyword",)).count() == 300 * 20
    assert size() - before < 300_000


def test_selection_counts_each_passage_of_a_repeated_id_once(spark, tmp_path):
    import __spark_entry__ as entry

    d = str(tmp_path)
    # Chunk 1 stands in two notes with different texts; queries 50 and 100 have the same text.
    chunks = [(1, 1, 0, "", "alpha of the durable note", 9), (1, 2, 0, "", "alpha of the journal", None), (2, 1, 1, "", "nothing of it", 4)]
    notes = [(1, "a.md", "", [], 1.0, "", "", "durable"), (2, "b.md", "", [], 1.0, "", "", "journal")]
    spark.createDataFrame(chunks, "chunk_id bigint, note_id bigint, seq int, breadcrumb string, body string, tokens int").write.parquet(f"{d}/chunks.parquet")
    spark.createDataFrame(notes, "note_id bigint, path string, title string, tags array<string>, mtime double, digest string, project string, tier string").write.parquet(f"{d}/notes.parquet")
    spark.createDataFrame([(50, "alpha"), (100, "alpha"), (150, "absent"), (200, None)], "id bigint, text string").write.parquet(f"{d}/queries.parquet")
    for name, extra in (("budget_select", ()), ("redundancy_select", (0,))):
        rows = {tuple(r) for r in entry.queries()[name](spark, d).collect()}
        assert rows == {(i, "1,1", 2, 9 + 5, 2, 0, *extra) for i in (50, 100)}


def test_selection_reads_texts_in_blocks(spark, monkeypatch):
    from skriva.session import stored

    monkeypatch.setattr(select, "BLOCK_ITEMS", 3)
    texts = {i: f"passage {i % 5} of the same few words that are said again and again {i % 5}" for i in range(12)}
    p = spark.createDataFrame([(i, t, 1, 1) for i, t in texts.items()], "chunk_id bigint, body string, tokens int, cost int")
    kept = stored(p, "row")
    ordered = kept.crossJoin(spark.range(1, 6).withColumnRenamed("id", "query_id")).withColumn("position", F.col("chunk_id") % (F.col("query_id") + 2) * 100 + F.col("chunk_id")).where("position % 7 <> 3")
    assert sorted(select.select_stored(ordered, kept, 8, 5).collect()) == sorted(select.select_hits(ordered, p, 8, 5).collect())


def test_all_terms_takes_the_whole_log(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    ids = {r.query_id for r in entry.queries()["bm25_all_terms"](spark, d).collect()}
    assert len({i % 50 for i in ids}) > 10


def test_all_terms_looks_only_for_what_it_ranks(spark, monkeypatch):
    """No single terms and no windows in its index; passages that cannot be among the best are left out early, without a change to the result."""
    import random

    import pyarrow as pa

    from skriva.operators import postings

    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta"]
    p = spark.createDataFrame([(i, "", "", "", " ".join(r.choices(words, k=r.randint(2, 12)))) for i in range(3000)], "chunk_id bigint, title string, tags string, breadcrumb string, body string").repartition(12)
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta alpha"), (3, "single"), (4, "検索語彙の窓")], "query_id bigint, text string")
    index = search.keyword_index(p, q, labels=("all-terms",))
    assert len(index.files) > 3
    assert {t for row in postings._rows(index.files, ["terms"]) for t in row["terms"].as_py()} == set(words)
    assert {x.query_id for x in search.keyword_rankings(p, q, 8, labels=("all-terms",)).collect()} == {1, 2}
    terms = [["alpha", "beta"], ["alpha", "delta", "gamma"], words]
    batch = pa.RecordBatch.from_pydict({"unit": [1, 2, 3], "terms": terms, "n": [2, 3, 4], "windows": pa.array([[]] * 3, pa.list_(pa.string()))})
    # In this process, where the blocks are small.
    ranked = lambda: [x for b in postings._ranked(index, 8, ("all-terms",), False, True)(iter([batch])) for x in b.to_pylist()]
    monkeypatch.setattr(postings, "BLOCK_DOCS", 300)
    monkeypatch.setattr(postings, "TIERS", (0.0, 0.1, 0.5))
    few = ranked()
    monkeypatch.setattr(postings._Best, "most", lambda *_: float("inf"))
    assert len(few) == 24 and few == ranked()


def test_search_takes_the_whole_log(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    ids = {r.query_id for r in entry.queries()["search_hybrid"](spark, d).collect()}
    assert len({i % 50 for i in ids}) > 10


def test_blocked_equals_window(spark, monkeypatch):
    monkeypatch.setattr(blocked, "BLOCK", 3)
    df = spark.createDataFrame([("k", i, None if i % 4 else f"v{i}") for i in range(20)] + [(None, 1, "z")], "k string, i bigint, v string").where("k IS NOT NULL")
    sums = {r.i: r.s for r in blocked.running_sum(df, ["k"], ["i"], F.lit(1), "s").collect()}
    assert sums == {i: i + 1 for i in range(20)}
    prev = {r.i: r.p for r in blocked.previous_value(df, ["k"], ["i"], F.col("v"), "p").collect()}
    assert prev[0] is None and prev[1] == "v0" and prev[4] == "v0" and prev[19] == "v16"


def test_orphans(spark):
    notes = spark.createDataFrame([(1, "a/My Note.md", "Other"), (2, None, None)], "note_id bigint, path string, title string")
    links = spark.createDataFrame(
        [(1, "my  note.md#x", "2024-01-01"), (9, "other|z", "2024-01-01"), (1, "gone", "2024-02-01"), (1, "gone", "2024-02-02"), (1, None, None), (None, "gone", None), (1, "#only", None)],
        "src_note_id bigint, target string, seen_at string",
    ).withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz")).withColumn("n", F.lit(0)).withColumn("name", F.lit(""))
    assert {tuple(r) for r in orphans.link_orphans(links, notes).collect()} == {(9, "other|z", "src"), (1, "gone", "target")}
    report = {(r.side, r.month): (r.orphan_rows, r.orphan_keys) for r in orphans.link_orphan_report(links, notes).collect()}
    assert report == {("src", "2024-01"): (1, 1), ("target", "2024-02"): (2, 1)}
    assert orphans.link_orphans(links.limit(0), notes).count() == 0


def test_near_duplicates_match_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = [(1, base), (2, base), (3, base + " tail"), (4, "x y z"), (5, None), (6, ""), (7, " ".join(f"v{i}" for i in range(60)))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    pairs = [(r.left, r.right) for r in neardup.similar_pairs(df, "doc_id", "text").collect()]
    assert pairs == [(1, 3)]
    classes = {r.doc_id: (r.class_id, r.links) for r in neardup.duplicate_classes(df, "doc_id", "text").collect()}
    assert classes == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 0), 6: (6, 0), 7: (7, 0)}


def test_every_document_has_a_class(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    rows = entry.queries()["near_duplicate_classes"](spark, d).collect()
    assert len(rows) == len(docs) and {r.doc_id for r in rows} == set(docs)
    empty = [r for r in rows if docs[r.doc_id] is None]
    assert empty and all((r.class_id, r.links) == (r.doc_id, 0) for r in empty)


def test_passage_duplicates_match_brute_force(spark, monkeypatch):
    from skriva.operators.select import shingle_set

    monkeypatch.setattr(neardup, "BLOCK_GRAMS", 400)
    japanese = "認証の設計は端末の側で鍵を作り、署名だけを送ることにした。理由は鍵を外へ出さないため。"
    long = " ".join(f"word{i * i}" for i in range(40))
    bodies = [japanese, japanese + "移行の前に、古い署名をすべて無効にしておく必要がある。" * 3, long, long + " and " + long[::-1], "ABC  def ghi", "x abc def ghi and so on", long[:200] + "?" * 60, "", None]
    rows = [(i, f"{i}.md", "h", b) for i, b in enumerate(bodies)] + [(100 + i, f"copy{i // 2}.md", "h", "the same  note in many Places") for i in range(90)]
    df = spark.createDataFrame(rows, "chunk_id bigint, path string, breadcrumb string, body string")
    sets = {i: (path, shingle_set(b)) for i, path, _, b in rows}
    want = {
        (i, j)
        for i, (p, a) in sets.items()
        for j, (q, b) in sets.items()
        if i < j and p != q and min(len(a), len(b)) >= 10 and len(a & b) / min(len(a), len(b)) >= 0.8
    }
    links = {i: sum(i in p for p in want) for i in sets}
    classes = {r.chunk_id: (r.class_id, r.links) for r in neardup.passage_classes(df).collect()}
    assert {i: n for i, (_, n) in classes.items()} == links
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        for i, j in want:
            root[i] = root[j] = min(root[i], root[j])
    assert {i: c for i, (c, _) in classes.items()} == root
    got = [(r.left, r.right) for r in neardup.passage_duplicates(df).collect()]
    assert {(0, 1), (2, 3)} < want and len(want) > 3900
    assert len(got) == len(set(got)) and set(got) == want


def test_vectors_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = v.where("vec_id % 50 = 0")
    exact = {(r.query_id, r.chunk_id) for r in vectors.cosine_ranking(q, v, 5, -1.0).collect()}
    cells, indexed, n = vectors.rebuild_index(v)
    assert n == v.count() and len(cells.centres) == int(n**0.5)
    probes = vectors.probes_for(q, indexed, cells, 5, -1.0)
    near = {(r.query_id, r.chunk_id) for r in vectors.ann_ranking(q, indexed, cells, probes, 5, -1.0).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r.chunk_id) for r in vectors.cosine_ranking(odd.where("vec_id = 1"), odd, 5).collect()] == [(1, 1)]


def test_stored_ranking_equals_the_exact_one_and_shuffles_only_the_best(spark, monkeypatch):
    import numpy as np

    from skriva.session import stored

    monkeypatch.setattr(vectors, "QUERY_ROWS", 7)
    monkeypatch.setattr(vectors, "VECTOR_ROWS", 50)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 6)]) for i in range(600)] + [(600, None), (601, [0.0] * 6), (602, [1.0] * 5)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    q = v.where("vec_id % 9 = 0")
    got = sorted(tuple(x) for x in vectors.stored_ranking(q, stored(v.where("vec_id < 602")), 10).collect())
    assert got and got == sorted(tuple(x) for x in vectors.cosine_ranking(q.where("vec_id < 602"), v.where("vec_id < 602"), 10).collect())


def test_search_of_a_log_in_parts(spark, monkeypatch):
    from skriva import memory
    from skriva.session import stored

    monkeypatch.setattr(memory, "SEARCHED_AT_ONCE", 2)
    rows = [(i, f"n{i}.md", "", "", "", f"alpha {w} text of {i}", 5, p, "durable", 5) for i, (w, p) in enumerate([("beta", "x"), ("gamma", "y"), ("beta", "y"), ("delta 設計", "x")])]
    p = stored(spark.createDataFrame(rows, "chunk_id bigint, path string, title string, tags string, breadcrumb string, body string, tokens int, project string, tier string, cost int"), "row")
    q = spark.createDataFrame([(1, "alpha"), (2, "gamma"), (3, "alpha"), (4, "beta text"), (5, None), (6, "設計"), (7, "gamma")], "query_id bigint, text string")
    none = lambda asked: asked.selectExpr("query_id", "'semantic' AS label", "1L AS rank", "query_id AS chunk_id", "1.0D AS score").where("false")
    got = sorted(tuple(x) for x in memory.search_log(p, q, none, scope="project", project="x").collect())
    assert got == sorted(tuple(x) for x in memory.search_batch(p.drop("row"), q, scope="project", project="x").collect())
    assert {x[0] for x in got if x[-1]} == {2, 7}


def test_registered_index_search_finds_its_share(spark):
    from skriva.plans import catalog_search

    for d in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        for whole, index in ((catalog_search.cosine_topk, catalog_search.ann_cells), (catalog_search.cosine_seen, catalog_search.ann_scoped)):
            exact, near = ({(r.query_id, r.chunk_id, r.score) for r in f(spark, d).collect()} for f in (whole, index))
            assert len(exact & near) / len(exact) >= 0.9 and len(near) >= 0.9 * len(exact), (d, index.__name__)


def test_vectors_are_replaced(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    own = spark.createDataFrame([(i, [float(i), 1.0], i) for i in range(1, 9)], schema)
    cells, indexed, n = vectors.rebuild_index(own, keep=["label"])
    new = spark.createDataFrame([(3, [0.0, 1.0], 30), (3, [0.0, 0.5], 31), (9, None, 9), (10, [1.0, 2.0, 3.0], 10), (None, [1.0, 1.0], 1)], schema)
    got = {r.vec_id: r for r in vectors.upsert_vectors(indexed, new, cells).collect()}
    assert set(got) == {*range(1, 11)} and got[3].embedding == [0.0, 1.0] and got[3].label == 30 and got[3].cell >= 0 and got[9].cell == got[10].cell == -1
    assert {r.cell for r in vectors.upsert_vectors(indexed, new, None).where("vec_id IN (3, 9)").collect()} == {-1}
    assert vectors.rebuild_index(own.limit(0))[0] is None


def test_snapshots(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "s"))
    assert store.read("notes") is None
    store.commit({"notes": spark.createDataFrame([("a", 1)], "path string, x int")}, {"schema_version": 1})
    store.update("notes", lambda old: snapshots.replace_rows(old, spark.createDataFrame([("a", 2, "n"), ("b", 3, "n")], "path string, x int, y string"), ["path"]))
    assert sorted((r.path, r.x) for r in store.read("notes").collect()) == [("a", 2), ("b", 3)]
    assert store.migrate(2, ["notes"]) and store.read("notes") is None and not store.migrate(2, [])


def test_state_and_settings(tmp_path):
    p = str(tmp_path / "x" / "state.json")
    assert state.read_state(p)["imported"] == []
    state.write_state(p, {"imported": ["b", "a", "b"]})
    assert state.read_state(p)["imported"] == ["a", "b"]
    (tmp_path / "x" / "state.json").write_text("{broken")
    assert state.read_state(p)["imported"] == []
    s = state.Settings.resolve({"SKRIVA_LIMIT": "-3", "SKRIVA_BUDGET": "7", "SKRIVA_INCLUDE": "a/, a,b"})
    assert (s.limit, s.budget, s.include) == (8, 7, ("a", "b"))
    with pytest.raises(ValueError):
        state.inside(str(tmp_path), "../x")


def test_transcripts(spark):
    claude = [
        {"type": "user", "message": {"content": "hello"}},
        {"type": "user", "isSidechain": True, "message": {"content": "no"}},
        {"type": "assistant", "message": {"content": [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": " hi "}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}, {"type": "tool_use", "name": "mcp__skriva__x", "input": {}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": [{"type": "text", "text": "a"}, "b"]}, {"type": "text", "text": "<system>"}]}},
        {"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "Read", "input": {"file_path": "f"}}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "g"}}]}},
    ]
    codex = [
        {"type": "session_meta", "payload": {"cwd": "/w"}},
        {"type": "e", "payload": {"type": "user_message", "message": "go"}},
        {"type": "e", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"cmd": ["ls", "-l"]})}},
        {"type": "e", "payload": {"type": "function_call", "name": "patch", "arguments": {"path": "p"}}},
        {"type": "e", "payload": {"type": "function_call_output", "output": "out"}},
    ]
    rows = [("c", i, json.dumps(x)) for i, x in enumerate(claude)] + [("c", 99, "{broken"), ("c", 98, "")]
    lines = spark.createDataFrame(rows, "session_id string, line_no int, value string")
    got = [(r.kind, r.text) for r in transcripts.numbered(transcripts.claude_turns(transcripts.parsed_lines(lines)), "claude").orderBy("seq").collect()]
    assert got == [("user", "hello"), ("agent", "hi"), ("command", "ls"), ("result", "a\nb"), ("command", "Read: f"), ("edit", "g")]
    lines = spark.createDataFrame([("x", i, json.dumps(x)) for i, x in enumerate(codex)], "session_id string, line_no int, value string")
    parsed = transcripts.parsed_lines(lines)
    got = [(r.kind, r.text) for r in transcripts.numbered(transcripts.codex_turns(parsed), "codex").orderBy("seq").collect()]
    assert got == [("user", "go"), ("command", "ls -l"), ("edit", "p"), ("result", "out")]
    assert transcripts.folders_of(parsed).first()["cwd"] == "/w"


def test_transcript_turns_have_no_cap(spark, monkeypatch):
    import __spark_entry__ as entry

    rows = entry.queries()["transcript_turns"]
    whole = rows(spark, "/root/testdata/sf0.001").count()
    monkeypatch.setattr(transcripts.parsed_lines, "__defaults__", (1000,))
    assert rows(spark, "/root/testdata/sf0.001").count() == whole > 0


def test_episode(spark):
    rows = [("s", i, i, k, t, "", None) for i, (k, t) in enumerate([("user", "Please fix it\nnow"), ("command", "ls"), ("command", "ls"), ("result", "fine"), ("edit", "a.py"), ("result", "1 passed"), ("agent", "password=hunter2hunter2")])]
    t = clean_turns(spark.createDataFrame(rows, "session_id string, seq int, turn_id bigint, kind string, text string, detail string, logged_at timestamp"))
    assert [(r.first_seq, r.said) for r in command_blocks(t).collect()] == [(1, "```\n$ ls\nedited a.py\n```")]
    e = episodes(t).first()
    assert e["title"] == "Please fix it" and "[redacted]" in e["body"] and e["body"].index("$ ls") < e["body"].index("1 passed")


def test_workspace(spark):
    folders = spark.createDataFrame([("/w/a/b",), ("/w/ab",), ("/home/u",)], "path string")
    marks = spark.createDataFrame([("/w", "all"), ("/w/a/", "alpha")], "mark string, name string")
    got = {r.path: (r.project, r.origin) for r in workspace.resolve(folders, marks.limit(0), marks, "/home/u").collect()}
    assert got == {"/w/a/b": ("alpha", "registry"), "/w/ab": ("all", "registry"), "/home/u": ("", "folder")}


def test_workspace_steps_in_order(spark):
    folders = spark.createDataFrame([(p,) for p in ("/w/a/b", "/w/r/x", "/w/g/x/y", "/w/n", "/home/u")], "path string")
    marks = lambda *rows: spark.createDataFrame(rows, "mark string, name string")
    got = workspace.resolve(folders, marks(("/w/a", "A")), marks(("/w/a/b", "B"), ("/w/r", "R")), "/home/u", repositories=marks(("/w/r/x", "X"), ("/w/g", "G"), ("/w/g/x", "GX")))
    assert {r.path: (r.project, r.origin) for r in got.collect()} == {
        "/w/a/b": ("A", "marker"), "/w/r/x": ("R", "registry"), "/w/g/x/y": ("GX", "git"), "/w/n": ("n", "folder"), "/home/u": ("", "folder")
    }


def test_attribution_keeps_a_bounded_memory():
    offered, reads = streams.attribute([], [("offer", "a", 1), ("offer", "b", 2), ("offer", "c", 3), ("read", "a", 4), ("read", "c", 5), ("read", "c", 6)], keep=2)
    assert reads == [("c", 5)] and offered == ["b"]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("s", "2024-01-01 00:00:00"), ("s", "2024-01-01 00:05:00"), ("s", "2024-01-01 01:00:00"), ("z", "2024-01-02 00:00:00")], "session_id string, t string").select("session_id", F.col("t").cast("timestamp").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.visits(stream).writeStream.format("memory").queryName("visits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {tuple(r) for r in spark.table("visits").collect()}
    assert got <= {tuple(r) for r in streams.visits(df).collect()} and len(got) >= 2


def test_catalogue_is_complete():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60
