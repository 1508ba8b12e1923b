"""Trees on disk, extraction, registry, store, reports, commands and the change stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from migrascope import cli
from migrascope.functions.paths import Matcher
from migrascope.operators import extract, registry, sinks, stats, store
from migrascope.sources import files as tsfiles
from migrascope.sources.ignore import rules
from migrascope.sources.models import model_files
from migrascope.streaming import live


def put(root, rel, text):
    path = root / rel
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    put(root, "app/legacy.ts", "import { Foo } from '../shared/models/foo';")
    put(root, "app/modern.tsx", "import { Bar } from '../shared_2023/models/bar'; const a = <p>don't</p>;")
    put(root, "app/_private/both.ts", "import { Foo } from '../shared/models/foo';\nimport { Bar } from '../shared_2023/models/bar';")
    put(root, "app/__tests__/none.spec.ts", "export const a = 1;")
    put(root, "app/bad.ts", b"import '\xff';")
    put(root, "app/empty.d.ts", "")
    put(root, "app/.hidden/x.ts", "import 'x';")
    put(root, "app/node_modules/y.ts", "import 'y';")
    put(root, "app/gen/.gitignore", "*.ts\n!keep.ts\n")
    put(root, "app/gen/drop.ts", "import 'z';")
    put(root, "app/gen/keep.ts", "import 'z';")
    put(root, "app/a.js", "import 'js';")
    put(root, "app/shared/models/foo.ts", "export class Foo {}\nexport interface FooModel {}")
    put(root, "app/shared/models/sub/no.ts", "export class No {}")
    put(root, "app/shared/interfaces.ts", "export interface Old {}")
    put(root, "app/shared_2023/models/bar.ts", "export class Other {}")
    put(root, "app/shared_2023/models/none.ts", "const a = 1;")
    return root


def analyzed(spark, tree, **more):
    return extract.analyze(tsfiles.tree(spark, str(tree / "app")), **more)


def test_walk(spark, tree):
    got = {r.rel_path for r in tsfiles.tree(spark, str(tree / "app")).select("rel_path").collect()}
    assert got == {"legacy.ts", "modern.tsx", "_private/both.ts", "__tests__/none.spec.ts", "bad.ts", "empty.d.ts", "gen/keep.ts", "shared/models/foo.ts", "shared/models/sub/no.ts", "shared/interfaces.ts", "shared_2023/models/bar.ts", "shared_2023/models/none.ts"}
    flat = {r.rel_path for r in tsfiles.tree(spark, str(tree / "app"), recursive=False).select("rel_path").collect()}
    assert flat == {"legacy.ts", "modern.tsx", "bad.ts", "empty.d.ts"}
    assert "_private/both.ts" not in {r.rel_path for r in tsfiles.tree(spark, str(tree / "app"), skip_dirs=("_private",)).collect()}
    with pytest.raises(ValueError):
        tsfiles.tree(spark, str(tree / "nowhere"))
    with pytest.raises(ValueError):
        tsfiles.tree(spark, str(tree / "app" / "bad.ts"))


@pytest.mark.parametrize(("pattern", "path", "hit"), [("*.ts", "a/b.ts", True), ("/b.ts", "a/b.ts", False), ("a/*.ts", "a/b.ts", True), ("**/x", "p/q/x", True), ("a/**", "a/b/c", True), ("[ab].ts", "a.ts", True), ("[!ab].ts", "a.ts", False), ("doc?", "docs", True), ("\\#x", "#x", True)])
def test_ignore_rules(pattern, path, hit):
    assert bool(rules(pattern)[0].pattern.match(path)) is hit


def test_scan(spark, tree):
    rows = analyzed(spark, tree).persist()
    got = {os.path.basename(r.path): r.status for r in extract.files_of(rows).collect()}
    assert got == {"legacy.ts": "legacy", "modern.tsx": "migrated", "both.ts": "partial", "none.spec.ts": "no_models", "empty.d.ts": "no_models", "keep.ts": "no_models", "foo.ts": "no_models", "no.ts": "no_models", "interfaces.ts": "no_models", "bar.ts": "no_models", "none.ts": "no_models"}
    r = stats.with_rates(stats.scan_stats(rows)).first()
    assert (r.total, r.legacy, r.migrated, r.partial, r.no_models, r.errors, r.needs_migration, r.with_models) == (12, 1, 1, 1, 8, 1, 2, 3)
    assert [(os.path.basename(e.path), e.error_kind) for e in extract.errors_of(rows).collect()] == [("bad.ts", "read")]
    rows.unpersist()


def test_registry(spark, tree):
    m = registry.models(model_files(spark, str(tree / "app/shared"), str(tree / "app/shared_2023")))
    assert {(r.name, r.source, tuple(r.exports)) for r in registry.latest(m).collect()} == {("Foo", "shared_legacy", ("Foo", "FooModel")), ("interfaces", "shared_legacy", ("Old",)), ("Bar", "shared2023", ("Other",))}
    assert {(r.source, r.models, r.exports) for r in registry.counts(m).collect()} == {("shared_legacy", 2, 3), ("shared2023", 1, 1)}
    got = {os.path.basename(r.path): r.status for r in analyzed(spark, tree, registry=registry.exports(m)).collect()}
    assert got["legacy.ts"] == "legacy" and got["modern.tsx"] == "no_models" and got["both.ts"] == "legacy"


def test_registry_needs_a_name(spark):
    known = spark.createDataFrame([("shared_legacy", "Foo")], "source string, export_name string")
    f = spark.createDataFrame([("a.ts", "import 'shared/models/x'; import * as Foo from 'shared/models/y'; import('shared/models/z');")], "path string, content string")
    row = extract.analyze(f, registry=known).first()
    assert [(i.kind, i.source) for i in row.imports] == [("side_effect", None), ("namespace", "shared_legacy"), ("dynamic", None)]
    none = known.where("false")
    assert {i.source for i in extract.analyze(f, registry=none).first().imports} == {None}


def test_custom_directories(spark):
    f = spark.createDataFrame([("a.ts", "import a from '../old/m/x'; import b from '../new/interfaces';")], "path string, content string")
    assert [i.source for i in extract.analyze(f, Matcher("old", "new", "m")).first().imports] == ["shared_legacy", "shared2023"]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", "legacy", 1), ("b", "legacy", 2)], "path string, status string, content_hash int")
    new = spark.createDataFrame([("a", "migrated", 3, False), ("b", "", 0, True), ("c", "partial", 4, None)], "path string, status string, content_hash int, gone boolean")
    assert {tuple(r) for r in store.upsert(old, new, deleted="gone").collect()} == {("a", "migrated", 3), ("c", "partial", 4)}
    probe = spark.createDataFrame([("a", 1), ("b", 9), ("z", 1)], "path string, content_hash int")
    assert {r.path for r in store.needs_update(probe, old).collect()} == {"b", "z"}
    assert {r.path for r in store.remove(old, probe.where("path = 'a'")).collect()} == {"b"}
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.read() is None
    s.upsert(old, batch=0)
    s.upsert(new, deleted="gone", batch=1)
    s.upsert(old, batch=1)  # taken in before
    assert {tuple(r) for r in s.read().collect()} == {("a", "migrated", 3), ("c", "partial", 4)}
    two = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "path string, ts int, v string")
    assert store.latest_by(two, "path", "ts").collect()[0].v == "y"


def test_reports(spark, tree, tmp_path):
    rows = analyzed(spark, tree).persist()
    files, counts = extract.files_of(rows), stats.scan_stats(rows)
    lines = sinks.csv_report(files).splitlines()
    assert lines[0] == "path,status,import_count,legacy_imports,migrated_imports"
    assert [x.split("/app/")[1] for x in lines[1:4]] == ["__tests__/none.spec.ts,No Models,0,0,0", "_private/both.ts,Partial,2,1,1", "empty.d.ts,No Models,0,0,0"]
    report = json.loads(sinks.json_report(counts, files))
    assert report["stats"] == {"total": 12, "legacy": 1, "migrated": 1, "partial": 1, "no_models": 8, "errors": 1}
    keep = next(f for f in report["files"] if f["path"].endswith("keep.ts"))
    assert keep["imports"][0]["source"] is None and keep["imports"][0]["path"] == "'z'"
    said = sinks.summary(counts)
    assert "Total files scanned: 12" in said and "Migration progress: 33.3%" in said and "Files needing work: 2" in said
    assert sinks.detailed(files).split("\n")[1].startswith("Legacy files (1):")
    odd = spark.createDataFrame([('a,"b"\n.ts', "import 'x';")], "path string, content string")
    assert sinks.csv_report(extract.analyze(odd)).split("\n", 1)[1] == '"a,""b""\n.ts",No Models,1,0,0\n'
    sinks.write_csv(files, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 11
    sinks.write_json(files, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 11
    rows.unpersist()


def test_sample_arithmetic(spark):
    one = spark.createDataFrame([(1247, 342, 756, 28, 121, 0)], "total long, legacy long, migrated long, partial long, no_models long, errors long")
    said = sinks.summary(one)
    assert "67.1%" in said and "Files needing work: 370" in said


def test_views(spark):
    f = spark.createDataFrame([("a-b/x.ts", "legacy"), ("a/b.ts", "legacy"), ("a/A.ts", "partial")], "path string, status string")
    assert [r.path for r in extract.by_path(f).collect()] == ["a/A.ts", "a/b.ts", "a-b/x.ts"]
    assert [r.path for r in extract.page(f, 1, 1).collect()] == ["a/b.ts"]
    assert {r.path for r in extract.filtered(f, "A/", "legacy").collect()} == {"a/b.ts"}
    g = spark.createDataFrame([("x.ts", "import 'q';\nimport {A} from 'shared/models/a';"), ("y.ts", "import 'q';"), ("z.ts", "")], "path string, content string")
    d = extract.analyze(g).select("path", extract.first_location(F.col("imports"))["line"].alias("line"))
    assert {tuple(r) for r in d.collect()} == {("x.ts", 2), ("y.ts", 1), ("z.ts", None)}


def test_browser(spark):
    from migrascope.operators.browse import Browser

    f = spark.createDataFrame([(f"{c}.ts", "legacy" if c in "ace" else "partial") for c in "edcba"], "path string, status string")
    b = Browser(f, height=2)
    assert b.chosen() is None and b.step(1).at == 0 and b.step(-1).at == 4 and b.top == 3 and b.step(1).at == 0 and b.top == 0
    assert b.turn(1).at == 2 and b.turn(5).at == 4 and b.turn(-1).at == 2 and b.turn(-9).at == 0
    assert b.last().chosen().path == "e.ts" and [r.path for r in b.in_sight().collect()] == ["d.ts", "e.ts"]
    assert b.go(9).at == 4 and b.first().at == 0
    only = b.narrowed(extract.with_status(f, "legacy"))
    assert (only.total, only.chosen().path, only.step(1).chosen().path) == (3, "a.ts", "c.ts")
    none = b.narrowed(f.where("false"))
    assert none.step(1).at is None and none.chosen() is None


def test_lookups(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.size() == 0 and not s.contains("a")
    s.upsert(spark.createDataFrame([("a", "legacy")], "path string, status string"))
    assert s.get("a").status == "legacy" and s.contains("a") and not s.contains("b") and s.size() == 1
    s.clear()
    assert s.read() is None


def test_progress():
    from types import SimpleNamespace as N

    said = []
    p = live.ScanProgress(said.append, each=100)
    for n in (60, 60, 10):
        p.onQueryProgress(N(progress=N(numInputRows=n)))
    p.onQueryTerminated(None)
    assert said == ["120 files scanned", "scan complete: 130 files"]


def test_events(spark):
    e = spark.createDataFrame([("a.ts", 0.0), ("a.ts", 0.05), ("b.js", 0.0), ("a.ts", 5.0)], "path string, s double").select("path", F.timestamp_seconds("s").alias("ts"))
    assert {(r.path, r.events) for r in live.debounce(e).collect()} == {("a.ts", 2), ("a.ts", 1), ("b.js", 1)}
    assert tuple(stats.batch_stats(e).first()) == (4, 3, 2)
    assert [r.path for r in stats.unique_paths(e).collect()] == ["a.ts", "b.js"]
    assert stats.typescript_events(e).count() == 3


def test_follow(spark, tree, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    run = lambda: live.follow(spark, str(tree / "app"), s, f"file://{tmp_path}/ck").awaitTermination()
    run()
    now = {os.path.basename(r.path): r.status for r in extract.files_of(s.read()).collect()}
    assert now["legacy.ts"] == "legacy" and "none.spec.ts" not in now and "empty.d.ts" not in now
    put(tree, "app/legacy.ts", "import { Bar } from '../shared_2023/models/bar';")
    os.utime(tree / "app/legacy.ts", ns=(1, 10**18))
    os.remove(tree / "app/modern.tsx")
    put(tree, "app/new.ts", "import 'rxjs';")
    run()
    now = {os.path.basename(r.path): r.status for r in extract.files_of(s.read()).collect()}
    assert now["legacy.ts"] == "migrated" and "modern.tsx" not in now and now["new.ts"] == "no_models" and now["both.ts"] == "partial"
    # counts come from the latest state, so they can't drift
    assert stats.scan_stats(s.read()).first().total == s.read().count()


def test_snapshots_in_a_folder(tree, tmp_path):
    r = tsfiles.ChangeReader({"path": str(tree / "app"), "state_dir": str(tmp_path / "st"), "max_files_per_batch": "5"})
    rows, at, seen = [None], r.initialOffset(), []
    while rows:
        got, nxt = r.read(at)
        rows = list(got)
        assert len(rows) <= 5 and "digest" in nxt
        assert [x[0] for x in r.readBetweenOffsets(at, nxt)] == [x[0] for x in rows]
        seen += [x[0] for x in rows]
        at = nxt
    assert len(seen) == len(set(seen)) == 12


def test_status_changes(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", 1, "legacy"), ("a", 2, "migrated"), ("b", 1, "partial")]
    spark.createDataFrame(rows, "path string, ts int, status string").coalesce(1).write.parquet(str(src))
    q = live.status_changes(spark.readStream.schema("path string, ts int, status string").parquet(str(src))).writeStream.format("memory").queryName("changes").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("changes").collect()} == {("a", None, "migrated"), ("b", None, "partial")}


def test_commands(spark, tree, tmp_path, capsys):
    base = ["--path", str(tree)]
    assert cli.main([*base, "scan", "--detailed"], spark) == 0
    out = capsys.readouterr()
    assert "Total files scanned: 12" in out.out and "Partial files (1):" in out.out and "bad.ts - " in out.err
    assert cli.main([*base, "--use-registry", "report", "--format", "csv", "--output", str(tmp_path / "r.csv")], spark) == 0
    assert "modern.tsx,No Models,1,0,0" in (tmp_path / "r.csv").read_text()
    assert cli.main([*base, "report"], spark) == 0
    assert json.loads(capsys.readouterr().out)["stats"]["errors"] == 1
    assert cli.main([*base, "watch", "--store", f"file://{tmp_path}/s", "--checkpoint", f"file://{tmp_path}/c", "--once"], spark) == 0
    with pytest.raises(ValueError):
        cli.main(["--path", str(tree), "--shared-path", "/nowhere", "scan"], spark)


def test_registry_keeps_rows_of_one_path_apart(spark):
    known = spark.createDataFrame([("shared_legacy", "Tax")], "source string, export_name string")
    code = ["import {Tax} from '../shared/models/tax'", "import {Fee} from '../shared/models/tax'", "", "import {Tax} from '../shared/models/tax'"]
    files = spark.createDataFrame([("a.ts", c) for c in code[:3]] + [(None, code[3])], "path string, content string")
    got = extract.analyze(files, registry=known).select("path", "status").collect()
    assert sorted((r.path or "", r.status) for r in got) == [("", "legacy"), ("a.ts", "legacy"), ("a.ts", "no_models"), ("a.ts", "no_models")]


def test_files_that_cannot_be_read(spark, tmp_path, capsys):
    """They count in the total and as errors, and are listed."""
    from migrascope import cli

    for d in ("app/shared", "app/shared_2023"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "app/fine.ts").write_text("import 'x'")
    (tmp_path / "app/lost.ts").symlink_to(tmp_path / "nowhere.ts")
    from migrascope.sources.files import listed, tree

    rows = {r.rel_path: r.error for r in tree(spark, str(tmp_path / "app"), follow_links=True).collect()}
    assert rows["fine.ts"] is None and rows["lost.ts"]
    files = tree(spark, str(tmp_path / "app"), follow_links=True)
    counts = stats.scan_stats(extract.analyze(files)).first()
    assert (counts.total, counts.errors, counts.no_models) == (2, 1, 1)
    assert [r.path.rsplit("/", 1)[1] for r in extract.errors_of(extract.analyze(files)).collect()] == ["lost.ts"]
    gone = listed(spark, [str(tmp_path / "app/never.ts")]).first()
    assert gone.content is None and gone.error is None
    assert cli.main(["--path", str(tmp_path), "scan", "--stats-only"], spark) == 0 and "Total" in capsys.readouterr().out


def test_store_survives_a_crash_at_the_pointer(spark, tmp_path):
    from migrascope.operators.store import Store

    store = Store(spark, str(tmp_path / "state"))
    rows = lambda n: spark.createDataFrame([(f"p{n}", n)], "path string, n int")
    assert store.read() is None and store.batch() == -1
    store.write(rows(0), 0)
    held = store.read()
    store.write(rows(1), 1)
    assert held.collect()[0].n == 0  # a reader of the version before goes on
    (tmp_path / "state/new-x").write_text("{")  # what a crash before the rename leaves
    assert store.batch() == 1 and store.read().collect()[0].n == 1
    store.write(rows(2), 2)
    assert [r.n for r in store.read().collect()] == [2] and len(list((tmp_path / "state").glob("current-*"))) == 2


def test_store_takes_in_change_runs(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "state"))
    rows = lambda lo, hi, v, gone: spark.range(lo, hi).select(F.concat(F.lit("p"), "id").alias("path"), F.lit(v).alias("n"), F.lit(gone).alias("gone"))
    s.upsert(rows(0, 1000, 0, False), deleted="gone", batch=0)
    base = s._pointer()["version"]
    want = {f"p{i}": 0 for i in range(1000)}
    for b, (lo, hi, gone) in enumerate([(0, 60, False), (10, 12, True), (11, 13, False), (990, 1005, False), (500, 501, True)], 1):
        s.upsert(rows(lo, hi, b, gone), deleted="gone", batch=b)
        s.upsert(rows(0, 900, 99, True), deleted="gone", batch=b)  # tried again: no effect
        for i in range(lo, hi):
            want.pop(f"p{i}", None) if gone else want.update({f"p{i}": b})
        got = s.read().collect()
        assert {r.path: r.n for r in got} == want and len(got) == len(want)
    now = s._pointer()
    assert now["version"] == base and len(now["runs"]) < 5  # the base stands, runs are merged
    s.upsert(rows(0, 300, 6, False).drop("gone"), batch=6)
    want |= {f"p{i}": 6 for i in range(300)}
    assert {r.path: r.n for r in s.read().collect()} == want
    now = s._pointer()
    assert now["version"] != base and not now.get("runs")
    s.write(rows(0, 1, 7, False).drop("gone"), 7)
    assert not (tmp_path / "state" / base).exists()  # nothing of versions that are gone is left
    assert len([p for p in (tmp_path / "state").iterdir() if p.is_dir()]) == 2


def test_bursts_wait_until_quiet(tmp_path):
    import os
    import time

    from migrascope.sources.files import ChangeReader

    f = tmp_path / "a.ts"
    f.write_text("1")
    reader = ChangeReader({"path": str(tmp_path), "quiet_ms": "600000"})
    rows, offset = reader.read(reader.initialOffset())
    assert list(rows) == []
    old = time.time_ns() - 700_000 * 1_000_000
    os.utime(f, ns=(old, old))
    rows, offset = reader.read(offset)
    assert [r[1] for r in rows] == ["a.ts"]
    f.write_text("2")
    rows, offset = reader.read(offset)
    assert list(rows) == []
