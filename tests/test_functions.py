"""Truth tables of the column functions."""

import pytest
from pyspark.sql import functions as F

from migrascope.config import Config, ScanConfig
from migrascope.functions import paths, status, text
from migrascope.functions.paths import Matcher, WatchFilter
from migrascope.operators.extract import Narrowing, next_status_filter


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


LEGACY = ["../shared/models/foo", "../../shared/models/foo", "shared/models/foo", "../shared/models/foo.ts", "../shared/models/codegen/foo.codegen", "../shared/models", "../shared/interfaces", "../shared/interfaces.ts", "shared/interfaces", "shared/models-old/x", "'../shared/models/foo'"]
MODERN = [p.replace("shared/", "shared_2023/") for p in LEGACY] + ["../shared_2023/interfaces.codegen", "../shared_2023/models/shared/models/foo"]
NEITHER = [f"../{d}/{x}" for d in ("shared", "shared_2023") for x in ("utils", "services", "constants", "components", "pipes", "directives", "guards")] + ["@angular/core", "rxjs", "lodash", "./local-file", "../components/foo", "shared_2023/shared/models/foo", ""]


def test_classification(spark):
    assert set(each(spark, LEGACY, Matcher().source)) == {"shared_legacy"}
    assert set(each(spark, MODERN, Matcher().source)) == {"shared2023"}
    assert set(each(spark, NEITHER, Matcher().source)) == {None}


def test_names(spark):
    assert each(spark, ["'../shared/models/active-contract'", "'../shared/interfaces'", "'../shared/models/foo.ts'", "''"], paths.model_name) == ["active-contract", "interfaces", "foo", None]
    assert each(spark, ["'foo'", '"foo"', "foo", "''"], paths.strip_quotes) == ["foo", "foo", "foo", ""]
    kebab = ["active-contract", "my-model-name", "simple", "a-b-c", "active-contract.ts", "active-contract.tsx", "underscore_case"]
    assert each(spark, kebab, text.kebab_to_pascal) == ["ActiveContract", "MyModelName", "Simple", "ABC", "ActiveContract", "ActiveContract", "UnderscoreCase"]
    assert each(spark, ["ActiveContract", "MyModelName", "Simple", "ABC"], text.pascal_to_kebab) == ["active-contract", "my-model-name", "simple", "a-b-c"]
    assert each(spark, ["a,b", 'a"b', "a\nb", "a\rb", "ab"], text.escape_csv) == ['"a,b"', '"a""b"', '"a\nb"', "a\rb", "ab"]
    assert each(spark, ["abcdefghij", "abc"], lambda c: paths.truncate_path(c, 6)) == ["...hij", "abc"]
    assert each(spark, ["a/b.ts", "a.b/c", ".ts", "x.d.ts", "a/.env"], paths.extension) == ["ts", None, None, "ts", None]


def test_filters(spark):
    f = WatchFilter().accepts
    good = ["src/app.ts", "src/App.tsx"]
    bad = ["app.js", "styles.css", "README.md", "app.spec.ts", "app.test.ts", "src/__tests__/a.ts", "src/__mocks__/a.ts", "types.d.ts"]
    assert each(spark, good + bad, f) == [True] * len(good) + [False] * len(bad)
    assert each(spark, ["app.spec.ts", "types.d.ts"], WatchFilter(include_tests=True, include_declarations=True).accepts) == [True, True]
    more = WatchFilter(extensions=("ts", "tsx", "mts"), exclude=(*paths.TEST_PARTS, "generated"))
    assert each(spark, ["a.mts", "src/generated/api.ts"], more.accepts) == [True, False]
    # taking tests in turns off own exclusions as well
    assert each(spark, ["src/generated/api.ts"], WatchFilter(include_tests=True, exclude=("generated",)).accepts) == [True]
    assert each(spark, ["a.js", "a.jsx", "a.css"], lambda c: paths.has_extension(c, ["ts", "tsx", "js"])) == [True, False, False]
    both = lambda c: paths.all_of(WatchFilter().accepts(c), ~F.contains(c, F.lit("node_modules")))
    assert each(spark, ["a.ts", "node_modules/a.ts"], both) == [True, False]
    assert each(spark, ["x"], lambda c: paths.all_of()) == [True]
    skipped = ["web/ui/node_modules/kit/index.ts", "packages/core/dist/main.ts", "a/.git/objects/x.ts", "legacy/vendor/old.ts", "web/ui/distance.ts", "vendored.ts"]
    assert each(spark, skipped, lambda c: paths.in_skipped_dir(c, ("vendor",))) == [True] * 4 + [False] * 2


@pytest.mark.parametrize(("sources", "want"), [([None, None], "no_models"), ([], "no_models"), (["shared_legacy", None], "legacy"), (["shared2023", None], "migrated"), (["shared_legacy", "shared2023"], "partial")])
def test_status(spark, sources, want):
    d = spark.createDataFrame([([(s,) for s in sources],)], "imports array<struct<source:string>>")
    assert d.select(status.imports_status(F.col("imports"))).first()[0] == want


@pytest.mark.parametrize(("legacy", "migrated", "partial", "want"), [(0, 0, 0, 100.0), (0, 100, 0, 100.0), (50, 50, 0, 50.0), (30, 60, 10, 60.0)])
def test_rates(spark, legacy, migrated, partial, want):
    d = spark.range(1).select(status.progress_percent(F.lit(legacy), F.lit(migrated), F.lit(partial)), status.success_rate(F.lit(100), F.lit(5)), status.success_rate(F.lit(0), F.lit(0)), status.scan_progress(F.lit(1), F.lit(0)))
    assert list(d.first()) == [want, 95.0, 100.0, None]


def test_labels(spark):
    s = ["legacy", "migrated", "partial", "no_models"]
    assert each(spark, s, status.label) == ["Legacy", "Migrated", "Partial", "No Models"]
    assert each(spark, s, status.mark) == ["[L]", "[M]", "[P]", "[-]"]
    assert each(spark, s, status.needs_migration) == [True, False, True, False]
    assert each(spark, ["shared_legacy", "shared2023", None], status.dir_name) == ["shared", "shared_2023", None]
    assert each(spark, ["interface", "code_gen_form_array"], status.category_suffix) == ["Model", "CodeGenFormArray"]
    assert [next_status_filter(x) for x in (None, *("legacy", "partial", "migrated", "no_models"))] == ["legacy", "partial", "migrated", "no_models", None]


def test_config():
    c = Config.from_json('{"scan": {"shared_dir": "custom_shared"}}')
    assert c.scan.shared_dir == "custom_shared" and c.scan.shared_2023_dir == "shared_2023" and c.watch.debounce_ms == 100
    assert Config.from_json(c.to_json()) == c
    assert Matcher.of(ScanConfig(shared_dir="/x/app/old", shared_2023_dir="/x/app/new/")) == Matcher("old", "new", "models")


def test_narrowing(spark):
    none = Narrowing()
    both = Narrowing("b/").next_status()
    assert not none.is_active and both.is_active and both.wanted == "legacy" and both.clear() == none and Narrowing("x").is_active
    files = spark.createDataFrame([("a/B/c.ts", "legacy"), ("a/b/d.ts", "partial"), ("e.ts", "legacy")], "path string, status string")
    assert [r.path for r in both.of(files).collect()] == ["a/B/c.ts"] and none.of(files).count() == 3
