import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from notemill.sources import files
from notemill.streaming import events

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "side string, n int, ts timestamp, page int"


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


ROWS = [("l", 0, at(0), 1), ("l", 1, at(100), 2), ("l", 2, at(279), 3), ("l", 3, at(459), 4), ("r", 4, at(460), 9), ("l", 5, at(5000), 5)]


def test_debounce(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(r.n for r in events.debounced(df, ["side"], "ts", "n", files.kept).collect()) == [2, 3, 4, 5]


def test_suppression(spark):
    rows = [("a", 0, at(0), 1), ("a", 1, at(599), 2), ("a", 2, at(600), 1), ("a", 3, at(700), 3), ("a", 4, at(800), 0), ("a", 5, at(1500), 4)]
    got = events.suppressed(spark.createDataFrame(rows, SCHEMA), ["side"], "ts", "page", "n").collect()
    assert sorted(r.n for r in got) == [0, 3, 5]


def run_stream(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams(spark, rocks, tmp_path):
    spark.createDataFrame([*ROWS, ("l", 6, at(3_600_000), 7)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = run_stream(spark, events.debounced_stream(source, ["side"], "ts", "page"), "bursts")
    assert sorted(r.page for r in got if r.page != 7) == [3, 4, 5, 9]
    got = run_stream(spark, events.suppressed_stream(source, "side", "ts", "page"), "taken")
    assert sorted(r.page for r in got if r.page != 7) == [1, 5, 9]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def viewed(rows, wait, quiet):
    """Each session's events one by one, with the clock of a viewer: [(session, n, fired at)]."""
    out = []
    for session in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == session), key=lambda r: (r[3], r[2]))
        current, quiet_until, waits = None, 0, {}
        for clock in range(0, max(r[3] for r in own) + wait + 1):
            for side in sorted(waits):
                due, page, n = waits[side]
                if due == clock:
                    del waits[side]
                    if page != current:
                        out.append((session, n, clock))
                        current, quiet_until = page, clock + quiet
            for _, side, n, t, page in own:
                if t == clock and clock >= quiet_until and page and page != current:
                    waits[side] = (clock + wait, page, n)
    return sorted(out)


def events_of(seed, sessions=4, n=60):
    rng = random.Random(seed)
    rows = [(f"s{k}", rng.choice("lr"), i, rng.randrange(3000), rng.choice([None, 0, 1, 2, 3, 4])) for i in range(n) for k in [rng.randrange(sessions)]]
    once = {(r[0], r[1], r[3]): r for r in rows}  # two events of one side and time have no order of their own here
    return sorted(once.values())


VIEW = "session string, side string, n int, ms int, page int"


@pytest.mark.parametrize("seed", range(4))
def test_synced_is_the_viewer(spark, seed):
    rows = events_of(seed)
    df = spark.createDataFrame(rows, VIEW).withColumn("ts", F.timestamp_millis(F.col("ms").cast("long"))).repartition(3)
    got = events.synced(df, ["session"], "side", "ts", "page", "n", 40, 100).collect()
    assert sorted((r.session, r.n, r.fired_at // 1000) for r in got) == viewed(rows, 40, 100)
    assert got[0].asDict().keys() == {*df.columns, "fired_at"}


@pytest.mark.parametrize("seed,side", [(0, "side"), (1, None)])
def test_stream_of_shuffled_batches_is_the_table(spark, rocks, tmp_path, seed, side):
    rows = events_of(seed + 10, n=90)
    last = [(f"s{k}", "l", 1000 + k, 10**9 + 10**8 * j, 9 + j) for k in range(4) for j in range(2)]
    df = spark.createDataFrame([*rows, *last], VIEW).withColumn("ts", F.timestamp_millis(F.col("ms").cast("long")))
    wait = 40 if side else 0
    want = {(r.session, r.n, r.fired_at) for r in events.synced(df, ["session"], side, "ts", "page", "n", wait, 100).collect() if r.n < 1000}
    random.Random(seed).shuffle(rows)
    for i in range(0, len(rows), 30):  # files are batches, in order of their names
        spark.createDataFrame(rows[i : i + 30], VIEW).coalesce(1).write.parquet(str(tmp_path / f"a{i:03}"))
    for j in range(2):
        spark.createDataFrame(last[j::2], VIEW).coalesce(1).write.parquet(str(tmp_path / f"b{j}"))
    for k, folder in enumerate(sorted(tmp_path.iterdir())):
        for f in folder.glob("*.parquet"):
            os.utime(f, (1_000_000 + k, 1_000_000 + k))
    source = spark.readStream.schema(VIEW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path))
    source = source.withColumn("ts", F.timestamp_millis(F.col("ms").cast("long")))
    got = run_stream(spark, events.synced_stream(source, "session", side, "ts", "page", "n", wait, 100, "1 hour"), f"synced{seed}")
    assert sorted((r.session, r.n, r.fired_at) for r in got if r.n < 1000) == sorted(want)


def test_a_repeat_of_the_current_page_stays_out_after_days(spark, rocks, tmp_path):
    rows = [("a", "l", k, (k + 1) * 86_400_000, 1) for k in range(3)] + [("a", "l", 9, 9 * 86_400_000, 2)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], VIEW).coalesce(1).write.parquet(str(tmp_path / f"a{k}"))
    source = spark.readStream.schema(VIEW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    source = source.withColumn("ts", F.timestamp_millis(F.col("ms").cast("long")))
    assert [r.n for r in run_stream(spark, events.suppressed_stream(source, "session", "ts", "page", order="n", lateness="1 second"), "days")] == [0]


def files_seen(spark, folder, checkpoint, out, **options):
    stream = events.changed_files(spark, str(folder), **options)
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).option("path", str(out)).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.name, r.content) for r in spark.read.parquet(str(out)).collect()) if any(out.glob("*.parquet")) else []


def test_file_stream(spark, tmp_path):
    folder, checkpoint, out = tmp_path / "notes", tmp_path / "state", tmp_path / "out"
    (folder / "sub").mkdir(parents=True)
    out.mkdir()
    (folder / "a.md").write_text("# A\nx")
    (folder / "sub/c.md").write_text("c")
    (folder / "b.txt").write_text("no")
    seen = lambda **how: files_seen(spark, folder, checkpoint, out, settle_ms=20, **how)
    time.sleep(0.1)
    assert seen() == [("a.md", "# A\nx"), ("sub/c.md", "c")]
    for text in ("second", "third"):  # each change is a row, and a restart repeats none
        (folder / "a.md").write_text(text)
        time.sleep(0.1)
        seen()
    want = sorted([("a.md", "# A\nx"), ("a.md", "second"), ("a.md", "third"), ("sub/c.md", "c")])
    assert seen() == want
    (folder / "sub/c.md").unlink()
    (folder / "d.md").write_text("new")
    (folder / "a.md").write_bytes(b"\xff not text")
    time.sleep(0.1)
    assert seen() == sorted([*want, ("d.md", "new"), ("a.md", "\ufffd not text")])
    assert spark.createDataFrame([("슬라이드 12",), ("x",)], "x string").select(events.page_of_heading(F.col("x"))).collect()[0][0] == 12


def test_file_changes_of_few_paths_and_odd_folders(spark, tmp_path):
    from notemill.streaming.files import listed, planned

    for k in range(7):
        (tmp_path / f"n{k}.md").write_text(str(k))
        os.utime(tmp_path / f"n{k}.md", ns=(10**18 + k, 10**18 + k))
    assert [n for n, *_ in listed(str(tmp_path), "*.md", 0, 10**18 + 3)] == ["n0.md", "n1.md", "n2.md", "n3.md"]
    assert [len(p) for p in planned(listed(str(tmp_path), "*.md", 10**18 + 1, 2 * 10**18), 2)] == [2, 2, 1]
    assert listed(str(tmp_path / "missing"), "*.md", 0, 2 * 10**18) == []
    assert [n for n, *_ in listed(f"file://{tmp_path}", "n[12].md", 0, 2 * 10**18)] == ["n1.md", "n2.md"]


def test_folders(spark, tmp_path):
    base = tmp_path / "vault"
    for p in ("CS/a.md", "CS/deck.pdf", "CS/Concepts/Graph Theory.md", "Math/b.md", "Exam/x.md", "Concepts/y.md"):
        os.makedirs(base / os.path.dirname(p), exist_ok=True)
        (base / p).write_text("%PDF-1" if p.endswith("pdf") else p)
    assert [r.name for r in files.notes(spark, str(base), "CS").collect()] == ["a"]
    (base / "CS/Concepts/C++ 100%.md").write_text("c")
    (base / "CS/C++.md").write_text("c")
    (base / "Empty").mkdir()
    assert sorted(r.name for r in files.notes(spark, str(base), "CS").collect()) == ["C++", "a"]
    assert sorted(r.name for r in files.concept_names(spark, str(base), "CS").collect()) == ["C++ 100%", "Graph Theory"]
    assert files.concept_names(spark, str(base), "Math").collect() == files.concept_names(spark, str(base), "Nobody").collect() == []  # a subject without concepts
    assert sorted(r.subject for r in files.subjects(spark, str(base)).collect()) == ["CS", "Empty", "Math"]
    assert [r.is_pdf for r in files.decks(spark, str(base)).collect()] == [True]


def test_sinks_and_state(spark, tmp_path):
    df = spark.createDataFrame([("s/n.md", "text")], "path string, content string")
    files.save_files(df, str(tmp_path / "out"))
    assert (tmp_path / "out/s/n.md").read_text() == "text"
    path = files.save_version(df, str(tmp_path / "t"), "1")
    assert spark.read.parquet(path).count() == 1
    state = str(tmp_path / "state")
    assert files.load_state(spark, state, "a int").count() == 0
    files.save_state(spark.range(2).selectExpr("int(id) a"), state)
    assert files.load_state(spark, state, "a int").count() == 2
    assert files.Settings.merged({"language": "en", "odd": 1, "provider": None}) == files.Settings(language="en")
    pages = spark.createDataFrame([("https://ok/1", "h"), ("https://no/1", "h")], "url string, html string")
    assert [r.html for r in files.fetched_pages(pages, ("ok",)).collect()] == ["h", None]


def test_versions_lose_no_update(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    assert files.newest_version(spark, folder) == (0, None)
    started = []

    def add(name, meanwhile=None):
        def update(current):
            started.append(name)
            if meanwhile is not None and started.count(name) == 1:
                add(meanwhile)  # another writer is faster
            rows = [] if current is None else [r.n for r in current.collect()]
            return spark.createDataFrame([(n,) for n in [*rows, name]], "n string")

        return files.updated_table(spark, folder, update)

    assert add("a")[0] == 1
    number, rows = add("b", meanwhile="c")
    assert number == 3 and sorted(r.n for r in rows.collect()) == ["a", "b", "c"] and started.count("b") == 2
    assert len(list((tmp_path / "t").glob("version=*"))) == 3  # what lost is gone
    assert not files.commit_version(spark, folder, 3, "x") and files.newest_version(spark, folder)[0] == 3

    def too_late(current):
        number, path = files.newest_version(spark, folder)
        assert files.commit_version(spark, folder, number + 1, path.split("version=")[1])
        return rows

    with pytest.raises(RuntimeError, match="changed by others"):
        files.updated_table(spark, folder, too_late, attempts=2)


def test_reimport(spark, tmp_path):
    from notemill.operators import merge

    folder = f"file://{tmp_path}/notes"
    block = lambda text, before="", after="": f"---\nt: 1\n---\n\n{before}<!-- note:start -->\n{text}\n<!-- note:end -->\n{after}"
    rows = lambda *r: spark.createDataFrame(r, "path string, content string")
    number, first = merge.reimported(spark, folder, rows(("a", block("one", after="\nmine\n")), ("b", block("b"))))
    assert number == 1 and not any(r.was_update for r in first.collect())
    number, second = merge.reimported(spark, folder, rows(("a", block("two")), ("c", block("c"))))
    got = {r.path: r for r in second.collect()}
    assert number == 2 and {p: (r.came, r.was_update) for p, r in got.items()} == {"a": (True, True), "b": (False, False), "c": (True, False)}
    assert "two" in got["a"].content and "one" not in got["a"].content and "mine" in got["a"].content and got["b"].content == block("b")


@pytest.fixture
def server():
    import http.server
    import threading

    class Pages(http.server.BaseHTTPRequestHandler):
        asked = []

        def do_GET(self):
            self.asked.append((self.path, self.headers["User-Agent"]))
            body, kind = {"/page": ("<title>Ü</title>".encode(), "text/html; charset=utf-8"), "/latin": ("<title>ü</title>".encode("latin-1"), "text/html; charset=ISO-8859-1"), "/deck.pdf": (b"%PDF-1.7 x", "application/pdf"), "/fake.pdf": (b"PK", "application/pdf")}.get(self.path, (b"no", None))
            self.send_response(200 if kind else 404)
            self.send_header("Content-Type", kind or "text/plain")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", Pages.asked
    made.shutdown()


def test_fetch(spark, server):
    from notemill.sources import web

    base, asked = server
    rows = [(1, f"{base}/page"), (2, f"{base}/latin"), (3, f"{base}/missing"), (4, "http://localhost:1/x"), (5, "http://example.invalid/"), (6, None), (7, "nonsense"), (8, f"{base}/page?too=long" + "x" * 10)]
    df = spark.createDataFrame(rows, "id int, url string").repartition(3)
    got = {r.id: (r.html, r.status, r.error) for r in web.fetched_html(df, ("127.0.0.1", "localhost"), agent="tester", timeout_s=5.0).collect()}
    assert got == {1: ("<title>Ü</title>", 200, None), 2: ("<title>ü</title>", 200, None), 3: (None, 404, web.NOT_FETCHED), 4: (None, None, web.NOT_FETCHED), 5: (None, None, web.NOT_ALLOWED), 6: (None, None, web.NOT_ALLOWED), 7: (None, None, web.NOT_ALLOWED), 8: (None, 404, web.NOT_FETCHED)}
    assert sorted(asked) == sorted((u.removeprefix(base), "tester") for i, u in rows if i in (1, 2, 3, 8))  # no other was asked for
    decks = spark.createDataFrame([(1, f"{base}/deck.pdf"), (2, f"{base}/fake.pdf"), (3, f"{base}/none.pdf"), (4, None)], "id int, pdf_url string")
    assert {r.id: (r.content and bytes(r.content), r.is_pdf) for r in web.fetched_decks(decks).collect()} == {1: (b"%PDF-1.7 x", True), 2: (b"PK", False), 3: (None, None), 4: (None, None)}
    small = web.fetched(decks.where("id = 1"), None, "pdf_url", most_bytes=3).first()
    assert small.content is None and small.error == web.NOT_FETCHED


def test_scraped_lines(spark, server):
    import json

    from notemill.sources import web

    base, asked = server
    asked.clear()
    df = spark.createDataFrame([(f"{base}/page",), (f"{base}/missing",), ("http://example.invalid/",)], "url string")
    lines = {d["url"]: d for r in web.scraped(df, ("127.0.0.1",)).collect() for d in [json.loads(r.value)]}
    assert lines[f"{base}/page"]["error"] == "no note data on the page" and lines[f"{base}/page"]["note_id"] == "page"
    assert lines[f"{base}/missing"] == {"url": f"{base}/missing", "error": web.NOT_FETCHED} and lines["http://example.invalid/"]["error"] == web.NOT_ALLOWED
    assert sorted(p for p, _ in asked) == ["/missing", "/page"]


def test_a_batch_is_listed_once(tmp_path, monkeypatch):
    from notemill.streaming import files as changes

    calls, real = [], changes.listed
    monkeypatch.setattr(changes, "listed", lambda *a: calls.append(a) or real(*a))
    for i in range(5):
        (tmp_path / f"{i}.md").write_text(str(i))
    reader = changes._Changes(str(tmp_path), "*.md", 0, 2)
    end = reader.latestOffset()
    parts = reader.partitions({"until": 0}, end)
    assert len(calls) == 1 and sorted(n for p in parts for n, _ in p.files) == [f"{i}.md" for i in range(5)]
    again = changes._Changes(str(tmp_path), "*.md", 0, 2)  # a new start knows nothing
    assert sorted(n for p in again.partitions({"until": 0}, end) for n, _ in p.files) == [f"{i}.md" for i in range(5)]
    assert reader.partitions(end, reader.latestOffset()) == []


@pytest.fixture
def odd_documents(spark, tmp_path):
    """A folder with documents whose texts are empty, or begin with white space so that their first word is."""
    texts = ["", "a b a", " ", "\n", " a b", "\na b\n", "", "a", "", "\n\n", "b\r\n a", "", "", " x", "x", "", "x\n", "x x"]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/written")
    (tmp_path / "odd").mkdir()
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "odd/documents.parquet")
    return str(tmp_path / "odd")


def test_empty_files_are_read(spark, odd_documents, tmp_path):
    from notemill.plans import catalog
    from tests.oracle import assert_same

    assert_same(catalog.QUERIES["note_files"], catalog.ORACLE_SQL["note_files"], spark, odd_documents)
    base = tmp_path / "my vault 100%25"
    for p, content in (("a b/x 1%.md", ""), ("a b/y.md", "é\r\n"), ("a b/.z.md", "hidden"), ("a b/d.pdf", ""), ("a b/deep/er/e.pdf", "%PDF"), ("top.pdf", "PK"), ("top.md", "no subject's")):
        os.makedirs(os.path.dirname(base / p), exist_ok=True)
        (base / p).write_bytes(content.encode())
    for folder in (str(base), f"file://{base}", f"file:{base}/"):
        for subject in ("*", "a b"):
            rows = files.notes(spark, folder, subject).collect()
            assert sorted((r.name, r.content) for r in rows) == [("x 1%", ""), ("y", "é\r\n")]
            assert {r.path for r in rows} == {f"{folder.rstrip('/')}/a b/{n}.md" for n in ("x 1%", "y")}
        assert sorted((os.path.basename(r.path), bytes(r.content), r.size, r.is_pdf) for r in files.decks(spark, folder).collect()) == [("d.pdf", b"", 0, False), ("e.pdf", b"%PDF", 4, True), ("top.pdf", b"PK", 2, False)]
    assert sorted(os.path.basename(r.path) for r in files.decks(spark, str(base), "{d,to?}.p*").collect()) == ["d.pdf", "top.pdf"]
    assert files.notes(spark, str(base), "missing").collect() == files.concept_names(spark, str(base), "*").collect() == []


@pytest.mark.parametrize("name", ["note_sections", "single_notes", "slide_notes"])
def test_texts_without_a_first_word_are_as_in_sql(name, spark, odd_documents):
    from notemill.plans import catalog
    from tests.oracle import assert_same

    assert_same(catalog.QUERIES[name], catalog.ORACLE_SQL[name], spark, odd_documents)


def test_the_driver_holds_no_names_of_files(spark, tmp_path):
    n = files.NAMES_AT_ONCE * 2 + 3
    for p in ("a/Concepts", "b"):
        (tmp_path / p).mkdir(parents=True)
    for k in range(n):
        (tmp_path / f"a/{k}.md").write_text("x")
    for p in ("a/Concepts/c.md", "b/1.md", "b/1.pdf"):
        (tmp_path / p).write_text("x")
    notes, decks, concepts = files.notes(spark, str(tmp_path), "*"), files.decks(spark, str(tmp_path)), files.concept_names(spark, str(tmp_path), "*")
    assert (notes.count(), decks.count(), concepts.count()) == (n + 1, 1, 1)
    assert [df.inputFiles() for df in (notes, decks, concepts)] == [[], [], []]
