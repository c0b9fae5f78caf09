"""Stored tables: refreshed month by month, published as wholes, met and looked up without a shuffle."""

import os
import shutil
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dashboard, diff, maps
from tidemark.plans import adapter, changes, ingest, store
from tidemark.plans import dashboard as dashboard_queries
from tidemark.sources import revisions, sinks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
MAY = date(1998, 5, 1)


@pytest.fixture(scope="module")
def given(tmp_path_factory):
    """A copy of the given tables, looked at when a look is due; and what may be said of companies in May."""
    monkeypatch = pytest.MonkeyPatch()
    d = f"{tmp_path_factory.mktemp('store')}/given"
    shutil.copytree(SF, d)
    for name in os.listdir(d):
        os.chmod(f"{d}/{name}", 0o644)
    monkeypatch.setattr(store, "FRESH_SECONDS", 1e9)
    told = {"plus": 0}

    def companies(spark, d):
        changed = F.when(F.col("competence") == MAY, F.col("share_capital") + F.lit(told["plus"])).otherwise(F.col("share_capital"))
        rows = adapter.companies(spark, d).withColumn("share_capital", changed.cast("decimal(18,2)")).drop("record_hash")
        return rows.withColumn("record_hash", adapter.keys.record_hash(rows))

    monkeypatch.setitem(store.SNAPSHOTS, "companies", (store.COMPANIES, companies))
    yield d, told
    monkeypatch.undo()


def touch(d, name="customer"):
    """Another file, by its time; and the next look is due."""
    os.utime(f"{d}/{name}.parquet", (time.time(), time.time()))
    due(d)


def due(d):
    for key, r in store._OPEN.items():
        if key[2] == d:
            r.looked = None


def rows_of(df):
    return sorted(map(str, df.collect()))


def folders(spark, d):
    return {k: r.folder for k, r in store.registry(spark, d).rows.items() if r.folder}


def test_only_what_a_month_is_in_is_made_again(spark, given):
    d, told = given
    for table in (store.events, store.metrics, store.observations):
        table(spark, d).count()
    before, made = folders(spark, d), store.events(spark, d).filter(F.col("to_month") == MAY).count()
    times = {f: os.path.getmtime(f) for f in (x.removeprefix("file://") for x in store.events(spark, d).inputFiles())}
    told["plus"] = 100
    touch(d)
    for table in (store.events, store.metrics, store.observations):
        table(spark, d).count()
    after = folders(spark, d)
    assert set(before) == set(after)
    moved = {(n, m.month if m else None) for (n, m), f in after.items() if before[n, m] != f}
    # May's companies; the pairs that begin or end with May; May's metrics and observations; nothing of other tables and months
    assert {m for n, m in moved if n in ("events", "issues", "changed_companies")} == {5, 6}
    assert {(n, m) for n, m in moved if n not in ("events", "issues", "changed_companies")} == {("companies", 5), ("metrics", 5), ("observations", 5), ("resolutions", None)}
    kept = {f for f in times if not any(f"to_month=1998-0{m}-01" in f for m in (5, 6))}
    assert kept and all(os.path.getmtime(f) == times[f] for f in kept)
    assert store.events(spark, d).filter(F.col("to_month") == MAY).count() > made
    assert rows_of(store.events(spark, d)) == rows_of(store.window_events(spark, d))
    assert rows_of(store.metrics(spark, d)) == rows_of(store.dashboard.regional_metrics(store.companies(spark, d), store.establishments(spark, d)))
    assert rows_of(store.observations(spark, d)) == rows_of(store.geo.observations(store.establishments(spark, d), store.companies(spark, d), store.resolved(spark, d)))
    # the same again publishes no month
    n = revisions.record(spark, store.registry(spark, d).root).filter("folder <> ''").count()
    touch(d)
    store.companies(spark, d).count()
    assert revisions.record(spark, store.registry(spark, d).root).filter("folder <> ''").count() == n


def test_a_stopped_build_publishes_nothing(spark, given, monkeypatch):
    """Snapshots are written and the record isn't: readers keep the revision before, and the next build is whole."""
    d, told = given
    old = rows_of(store.companies(spark, d))
    told["plus"] += 7
    touch(d)

    def stop(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(revisions, "commit", stop)
        with pytest.raises(RuntimeError, match="killed"):
            store.companies(spark, d)
    r = store._OPEN[spark.sparkContext.applicationId, id(spark), d]
    assert len(os.listdir(f"{r.root}/companies")) > 1  # what it wrote is there
    other = store.Registry(spark, d)
    other.rows = revisions.active(spark, other.root)
    assert rows_of(other.table("companies", store.COMPANIES.schema)) == old
    now = store.companies(spark, d)
    assert rows_of(now) == rows_of(store.SNAPSHOTS["companies"][1](spark, d).select(*now.columns)) != old


def test_a_failed_gate_keeps_events(spark, given, monkeypatch):
    d, told = given
    old = rows_of(store.events(spark, d))
    told["plus"] += 7
    touch(d)

    def refuse(_):
        raise ValueError("limit")

    with monkeypatch.context() as m:
        m.setattr(store.quality, "enforce", refuse)
        with pytest.raises(ValueError, match="limit"):
            store.events(spark, d)
    r = store.registry(spark, d)
    assert rows_of(r.table("events", r.schemas["events"])) == old
    assert rows_of(store.events(spark, d)) == rows_of(store.window_events(spark, d)) != old


def test_input_that_moves_while_it_is_read(spark, given, monkeypatch):
    d, told = given
    store.companies(spark, d).count()
    told["plus"] += 5
    touch(d)
    write = store.sinks.write_snapshots

    def late(df, contract, path, layout):
        told["plus"] += 1
        write(store.SNAPSHOTS["companies"][1](spark, d).filter(F.col("competence") == MAY), contract, path, layout)

    with monkeypatch.context() as m:
        m.setattr(store.sinks, "write_snapshots", late)
        with pytest.raises(ValueError, match="changed while"):
            store.companies(spark, d)
    now = store.companies(spark, d)
    assert rows_of(now) == rows_of(store.SNAPSHOTS["companies"][1](spark, d).select(*now.columns))


def test_changed_input_gives_changed_answers(spark, given):
    """Half of the customers are gone, so are their companies, places and events."""
    d, _ = given
    first = store.metrics(spark, d).agg(F.sum("value")).first()[0]
    some = spark.read.parquet(f"{SF}/customer.parquet").filter("c_custkey % 2 = 0").toPandas()
    some.to_parquet(f"{d}/customer.parquet")
    due(d)
    assert 0 < store.companies(spark, d).count() == adapter.companies(spark, d).count()
    assert rows_of(store.establishments(spark, d)) == rows_of(adapter.establishments(spark, d))
    assert store.metrics(spark, d).agg(F.sum("value")).first()[0] < first
    assert rows_of(store.events(spark, d)) == rows_of(store.window_events(spark, d))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_months_meet_in_place(spark):
    """Rows of a key share a bucket, so months are compared without a shuffle, with the same result."""
    pairs = store.pairs(spark)
    for table, key in ((store.companies, ["cnpj_basic"]), (store.establishments, ["cnpj"]), (store.partners, ["cnpj_basic", "partner_key"])):
        rows = table(spark, SF)
        found = diff.changed(rows, pairs, key, together=True)
        assert "Exchange hashpartitioning(cnpj" not in plan_of(found)
        assert rows_of(found) == rows_of(diff.changed(rows, pairs, key).select(*found.columns))


def test_lookups_read_one_bucket(spark):
    """By key a lookup reads the bucket of the key, not the others' files."""
    events = store.events(spark, SF)
    one = events.filter("cnpj_basic = '00000012'")
    assert "EqualTo(cnpj_basic,00000012)" in plan_of(one)
    files = {x.rsplit("_", 1)[1][:5] for x in (r[0] for r in one.select(F.input_file_name()).distinct().collect())}
    assert len(files) == 1
    scan = one.toDF(*one.columns)
    assert len(scan.collect()) == sum(r.cnpj_basic == "00000012" for r in events.collect())
    leaf = scan._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = leaf.metrics().get("numOutputRows").get().value()
    assert 0 < read < 0.7 * events.count()


def test_record(spark, tmp_path):
    """The highest published revision of a month is active, whatever order commits come in."""
    root = f"{tmp_path}/root"
    revisions.create(spark, root)
    assert revisions.active(spark, root) == {}
    for n, months in ((1, (1, 2)), (3, (2,)), (2, (1, 2))):
        revisions.commit(spark, root, [("t", date(2020, m, 1), n, f"f{n}", 1, "h", "s") for m in months])
    revisions.create(spark, root)
    assert {k[1].month: r.folder for k, r in revisions.active(spark, root).items()} == {1: "f2", 2: "f3"}
    seen = revisions.fingerprint(spark, [f"{root}/commits"])
    assert seen == revisions.fingerprint(spark, [f"{root}/commits"])
    revisions.commit(spark, root, [("t", date(2020, 1, 1), 4, "", 0, "", "")])
    assert seen != revisions.fingerprint(spark, [f"{root}/commits"])
    empty = revisions.open_table(spark, "t", spark.range(1).schema, revisions.Layout(), {})
    assert empty.count() == 0


def test_search_by_postings(spark):
    """By the start or a part of any of its names a company is found as by a scan of the month."""
    month = F.col("competence") == date(1999, 1, 1)
    firms, places = store.companies(spark, SF).filter(month), store.establishments(spark, SF).filter(month)
    index = store.names(spark, SF).filter(month)
    for query in ("Customer#0000001", "00042", "loja 1", "Loja", "ja", "r#0", "no such name", "42", "customer 000000042 "):
        want = store.dashboard.search(query, firms, places).collect()
        assert list(map(tuple, store.dashboard.indexed_search(query, index).collect())) == list(map(tuple, want)), query
    assert store.dashboard.indexed_search("00000012", index) is None and store.dashboard.indexed_search("x", index) is None
    one = index.filter("gram = '^cu'")
    assert len({x[0].rsplit("_", 1)[1][:5] for x in one.select(F.input_file_name()).distinct().collect()}) == 1


def test_medians_of_a_hot_key(spark):
    """A key of very many points and keys of few have the medians that sorting gives, whatever is held of them."""
    import numpy as np
    from tidemark.operators import geo

    r = np.random.default_rng(2)
    rows = [("hot", float(x), float(y), 1, str(i)) for i, (x, y) in enumerate(np.round(r.normal((-19, -47), 0.5, (3001, 2)), 6))]
    rows += [("even", float(x), float(y), 1, str(i)) for i, (x, y) in enumerate(np.round(r.normal((60, 179), 0.5, (400, 2)).clip(-180, 180), 6))]
    rows += [(f"k{i % 40}", round(float(r.uniform(-90, 90)), 6), round(float(r.uniform(-180, 180)), 6), 1, str(i)) for i in range(130)] + [("one", 1.5, -1.5, 2, "x"), ("same", 0.0, 0.0, 1, "a")] + [("tie", 1.0, 1.0 + k, 1, str(9 - k)) for k in range(2)]
    points = spark.createDataFrame(rows, "ibge string, latitude double, longitude double, level int, address_code string").repartition(5)
    got = {x.ibge: (x.mid_lat, x.mid_lon) for x in geo.medians(points, ["ibge"]).collect()}
    of = lambda k, c: float(np.median([x[c] for x in rows if x[0] == k]))
    keys = {x[0] for x in rows}
    assert set(got) == keys and all(got[k] == pytest.approx((of(k, 1), of(k, 2)), abs=1e-9) for k in keys)
    held = {x.ibge: x for x in geo.resolved_points(points, ["ibge"]).collect()}
    assert held["hot"].n == 3001 and held["even"].n == 400 and set(held) == keys
    far = lambda a, b: float(np.round(6371008.8 * 2 * np.arcsin(np.sqrt(np.sin(np.radians(b[0] - a[0]) / 2) ** 2 + np.cos(np.radians(a[0])) * np.cos(np.radians(b[0])) * np.sin(np.radians(b[1] - a[1]) / 2) ** 2)), 3))
    for k in ("hot", "even", "k1", "tie", "one"):
        own = [x for x in rows if x[0] == k]
        best = min((far((x[1], x[2]), (of(k, 1), of(k, 2))), x[4]) for x in own)
        assert (held[k].address_code, k) == (best[1], k)
    assert held["one"].dispersion == 0 and held["tie"].dispersion == pytest.approx(far((1, 1), (1, 2)), abs=0.01)
    s, w, t, e = (f(x[c] for x in rows if x[0] == "hot") for c, f in ((1, min), (2, min), (1, max), (2, max)))
    assert held["hot"].dispersion == pytest.approx(far((s, w), (t, e)), rel=1e-6)


def test_boxes_skip_files(spark):
    """Observations lie in the order of their places, so a small box reads fewer rows than the month has, and finds the same."""
    from tidemark.operators import geo

    z = spark.range(1).select(*[geo.cell(F.lit(float(a)), F.lit(float(b))) for a, b in ((-90, -180), (90, 180), (-90, 180), (90, -180), (0, 0))]).first()
    assert (z[0], z[1], z[2], z[3]) == (0, 0xFFFFFFFF, 0x55555555, 0xAAAAAAAA) and 0 < z[4] < z[1]
    month = store.observations(spark, SF).filter(F.col("competence") == date(1998, 9, 1))
    rows = [(float(r.longitude), float(r.latitude)) for r in month.collect() if r.latitude is not None]
    x, y = rows[0]
    box = month.filter(geo.inside_box(x, y, x + 0.001, y + 0.001))
    assert len(box.collect()) == sum(x <= a <= x + 0.001 and y <= b <= y + 0.001 for a, b in rows)
    read = box._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()
    assert read <= 0.75 * month.count()


def test_pages_of_a_stored_ranking(spark):
    """Every page of a ranking that is stored once, read from the partitions that hold it."""
    from tidemark.operators import pages

    rows = spark.range(1000).selectExpr("id * 7919 % 100 AS score", "id").repartition(5)
    want = [(r.score, r.id) for r in sorted(rows.collect(), key=lambda r: (-r.score, r.id))]
    held = pages.ranked(rows, [("score", True), ("id", False)], parts=6)
    assert held.total == 1000 and len(held.sizes) > 1
    for number, size in ((1, 10), (34, 10), (100, 10), (999, 10), (0, 300), (2, 999)):
        got = held.page(number, size)
        last = min(max(1, number), -(-1000 // size))
        found = sorted(got.collect(), key=lambda r: r.place)
        assert [(r.score, r.id) for r in found] == want[(last - 1) * size : last * size] and {(r.page_number, r.pages, r.total) for r in found} == {(last, -(-1000 // size), 1000)}
    assert "PartitionFilters: [isnotnull(part" in plan_of(held.page(50, 10))
    assert pages.ranked(rows.limit(0), [("id", False)]).page(3, 10).count() == 0


def test_companies_by_bitmaps(spark):
    """Counts of cells are those of the observations, under any selection that cells tell; also over several buckets of numbers."""
    seen, cells = store.observations(spark, SF), store.cells(spark, SF)
    month = max(store.registry(spark, SF).months("cells"))
    people = seen.select("municipality").distinct().withColumn("population", F.lit(3000))
    some = seen.filter(F.col("competence") == F.lit(month)).first()
    for chosen in ({}, {"branch_type": "1"}, {"branch_type": "2", "method": "ADDRESS"}, {"municipality": some.municipality, "tax_profile": some.tax_profile}, {"size_code": "01", "method": "UNLOCATED"}):
        selection = maps.Selection(month, **chosen)
        rows, sets = maps.selected(seen, selection), maps.selected_sets(cells, selection)
        plain, quick = maps.summary(rows), maps.summary_of_sets(sets)
        assert plain.columns == quick.columns and rows_of(plain) == rows_of(quick)
        assert rows_of(maps.by_municipality(rows)) == rows_of(maps.by_municipality_of_sets(sets).select(*maps.by_municipality(rows).columns))
        assert rows_of(maps.density(rows, people)) == rows_of(maps.density_of_sets(sets, people))
    plan = maps.summary_of_sets(maps.selected_sets(cells, maps.Selection(month)))._jdf.queryExecution().executedPlan().toString()
    assert "cnpj_basic" not in plan
    with pytest.raises(ValueError):
        maps.selected_sets(cells, maps.Selection(month, cnae_code="1234567"))
    assert cells.agg(F.sum("establishments")).first()[0] == seen.count()


def test_bitmaps_of_many_buckets(spark):
    """Companies of two cells are counted once, on both sides of a bucket's end; no rows give no companies."""
    n = 100_000
    base = spark.range(n).select(F.lit(MAY).alias("competence"), F.lpad(F.col("id").cast("string"), 8, "0").alias("cnpj_basic"), F.lit("a").alias("municipality"), F.lit("A").alias("municipality_name"), F.when(F.col("id") % 3 == 0, "2").otherwise("1").alias("branch_type"), F.lit("01").alias("size_code"), F.lit("MEI").alias("tax_profile"), F.lit("ADDRESS").alias("method"))
    rows = base.unionByName(base.filter("cnpj_basic < '00050000'").withColumns({"municipality": F.lit("b"), "municipality_name": F.lit("B"), "branch_type": F.lit(None).cast("string")}))
    numbers = spark.createDataFrame(maps.company_numbers(rows).toPandas())
    assert numbers.select("number").distinct().count() == n
    cells = maps.company_sets(rows, numbers)
    assert cells.filter("municipality = 'a'").select("bucket").distinct().count() > 3
    assert rows_of(maps.summary(rows)) == rows_of(maps.summary_of_sets(cells))
    assert rows_of(maps.by_municipality(rows)) == rows_of(maps.by_municipality_of_sets(cells).select(*maps.by_municipality(rows).columns))
    assert rows_of(maps.summary(rows.limit(0))) == rows_of(maps.summary_of_sets(cells.limit(0)))


def test_snapshots_are_shuffled_narrow_and_once(spark):
    """Rows lie in the parts that they are stored in before texts and months are made of them."""
    for name, (_, make) in store.SNAPSHOTS.items():
        key = store.LAYOUTS[name][1]
        plan = plan_of(make(spark, SF).repartition(adapter.buckets(spark, SF), key))
        assert plan.count(f"Exchange hashpartitioning({key}") == 1
        assert plan.index("Generate explode") < plan.index(f"Exchange hashpartitioning({key}")


def test_parts_grow_with_the_tables(spark, monkeypatch):
    said = spark.conf.get("spark.tidemark.buckets")
    spark.conf.unset("spark.tidemark.buckets")
    try:
        monkeypatch.setattr(adapter, "_PARTS", {})
        assert adapter.buckets(spark, SF) == adapter.BUCKETS
        held = sum(os.path.getsize(f"{SF}/{name}.parquet") for name in adapter.GIVEN)
        monkeypatch.setattr(adapter, "_PARTS", {})
        monkeypatch.setattr(adapter, "BUCKET_BYTES", held // 20)
        assert adapter.buckets(spark, SF) == 32
    finally:
        spark.conf.set("spark.tidemark.buckets", said)


def test_a_package_is_checked_without_a_shuffle(spark, tmp_path, monkeypatch):
    plans = []

    def report(df, contract):
        plans.append(plan_of(found := reported(df, contract)))
        return found

    reported = sinks.contract_report
    monkeypatch.setattr(sinks, "contract_report", report)
    layout = revisions.Layout("competence", "cnpj_basic", 2)
    rows = adapter.companies(spark, SF)
    sinks.write_snapshots(rows, store.COMPANIES, str(tmp_path / "whole"), layout)
    assert "Exchange hashpartitioning" not in plans[0]
    with pytest.raises(ValueError, match="repeated_identities"):
        sinks.write_snapshots(rows.unionByName(rows.filter("cnpj_basic = '00000012'")), store.COMPANIES, str(tmp_path / "twice"), layout)


def test_partners_meet_their_companies_in_place(spark):
    known = diff.comparable(store.companies(spark, SF), store.pairs(spark))
    rows = diff.changed(store.partners(spark, SF), store.pairs(spark), ["cnpj_basic", "partner_key"], together=True)
    plan = plan_of(diff.partner_events(rows, known))
    assert "Exchange hashpartitioning(cnpj_basic" not in plan


def test_candidates_meet_by_point(spark):
    """As keys, before they are texts; points are told apart where they have met."""
    spread = plan_of(store.reference(spark, SF))
    assert spread.count("Exchange hashpartitioning") - spread.count("Exchange hashpartitioning(l_suppkey") == 1
    assert "HashAggregate" not in spread and "REPARTITION_BY_NUM" in spread


def test_a_row_of_many_months_is_stored_once(spark):
    """Also where some of its months were published later, in another folder; changes are those of the months' rows."""
    r = store.registry(spark, SF)
    for name, (_, make) in store.SNAPSHOTS.items():
        held, rows = spark.read.parquet(*{x.folder for x in r.months(name).values()}), getattr(store, name)(spark, SF)
        keys = [c for c in rows.columns if c != "competence"]
        assert held.count() == rows.select(keys).distinct().count() < 0.7 * rows.count()
        assert rows_of(rows) == rows_of(make(spark, SF).select(*rows.columns))
        want = diff.changed(rows, store.pairs(spark), store.IDENTITIES[name])
        assert rows_of(store.changed(spark, SF, name).select(*want.columns)) == rows_of(want)


def test_spans_of_two_revisions(spark, tmp_path):
    """Of each folder the months count that it is the active one of; rows that meet again are one for what changed."""
    months = [date(2020, m, 1) for m in (1, 2, 3, 4)]
    layout, schema = revisions.Layout("competence", "k", 2, spans=True), "k string, record_hash string, competence date"
    one = spark.createDataFrame([("a", "x", m) for m in months] + [("b", "y", m) for m in months[1:3]], schema)
    two = spark.createDataFrame([("a", "z", months[1]), ("b", "y", months[1])], schema)
    for i, rows in enumerate((one, two)):
        revisions.write(store.spans.gathered(rows), f"{tmp_path}/t/{i}", layout)
    held = store.spans.gathered(one).schema
    found = revisions.open_table(spark, "t", held, layout, {m: f"{tmp_path}/t/{int(m == months[1])}" for m in months})
    want = one.filter(F.col("competence") != months[1]).unionByName(two)
    assert rows_of(store.spans.by_month(found).select(*want.columns)) == rows_of(want)
    pairs = diff.month_pairs(want)
    moved = store.spans.changed(found, pairs, ["k"])
    assert rows_of(moved) == rows_of(diff.changed(want, pairs, ["k"]).select(*moved.columns)) and moved.count() == 4
    assert "Exchange hashpartitioning(k" not in plan_of(moved)


def test_shuffles_are_released(spark, tmp_path):
    """A write leaves no shuffle behind, and the session is as it was."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: blocks.getAllFiles().size()
    before, had = held(), spark.conf.get(revisions.CLEANUP)
    with revisions.shuffles_released(spark):
        revisions.write(spark.range(1000).selectExpr("id AS k", "DATE '2020-01-01' AS competence"), f"{tmp_path}/t", revisions.Layout("competence", "k", 3))
    assert held() <= before and spark.conf.get(revisions.CLEANUP) == had


def test_the_cohort_is_met_once_for_each_content(spark):
    """No row of a month is shuffled by id; only counts by month are."""
    plan = plan_of(ingest.cohort_semi_join(spark, SF))
    below = [x.split("FileScan")[0] for x in plan.split("Generate explode(months")[1:]]
    assert len(below) == 2 and all("LeftSemi" in x for x in below)


def made_again(spark, monkeypatch, name):
    """The plans of the writes that make a table again, of which nothing is in the registry meanwhile."""
    plans, wrote, table = [], revisions.write_in_turn, getattr(store, name)
    monkeypatch.setattr(revisions, "write_in_turn", lambda slices, *rest: wrote([(plans.append(plan_of(df)) or df, n) for df, n in slices], *rest))
    before, r = rows_of(table(spark, SF)), store.registry(spark, SF)
    plans.clear()
    monkeypatch.setattr(r, "rows", {k: v for k, v in r.rows.items() if k[0] != name})
    assert rows_of(table(spark, SF)) == before
    return plans


def test_events_are_stored_where_their_rows_lie(spark, monkeypatch):
    """Of events only those of establishments are shuffled into their parts."""
    (plan,) = made_again(spark, monkeypatch, "events")
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange hashpartitioning(cnpj_basic") == 1


@pytest.mark.parametrize("name", ["events", "observations", "names"])
def test_large_tables_are_written_in_slices(spark, monkeypatch, name):
    """Of months, or of one month's keys; together they are the table."""
    monkeypatch.setattr(store, "SLICE", 1)
    assert len(made_again(spark, monkeypatch, name)) == 2


def test_names_are_shuffled_once_by_company(spark):
    """Establishments' names meet their companies where they were told apart; a name that two have of one company is there once."""
    firms = store.companies(spark, SF).filter("competence = DATE '1998-12-01'")
    places = store.establishments(spark, SF).filter("competence = DATE '1998-12-01'")
    twice = places.withColumn("trade_name_search", F.when(F.substring("cnpj", 14, 1) == "1", "customer 000000012").otherwise(F.col("trade_name_search")))
    index = dashboard.search_index(firms, twice)
    assert index.count() == index.distinct().count() > 0
    plan = plan_of(index)
    assert plan.count("trade_name_search") and "Exchange hashpartitioning(competence" in plan
    assert not [x for x in plan.split("Exchange hashpartitioning(")[1:] if "name#" in x.split(",")[2]]


def copy_of(folder, monkeypatch):
    """The given tables under a name that no registry has, and companies as they are."""
    monkeypatch.setitem(store.SNAPSHOTS, "companies", (store.COMPANIES, adapter.companies))
    d = f"{folder}/given"
    shutil.copytree(SF, d)
    return d


def test_only_snapshot_tables_that_are_read_are_made(spark, tmp_path, monkeypatch):
    """a query on one snapshot table neither makes nor stores the others; of several read at different times none is older than the files."""
    d = copy_of(tmp_path, monkeypatch)
    made = lambda: {n for n, _ in store._OPEN[spark.sparkContext.applicationId, id(spark), d].rows if n in store.SNAPSHOTS}
    assert ingest.dimension_conflicts(spark, d).count() and changes.company_events(spark, d).count()
    assert made() == {"companies"}
    some = spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderkey % 3 > 0").toPandas()
    os.chmod(f"{d}/orders.parquet", 0o644)
    some.to_parquet(f"{d}/orders.parquet", coerce_timestamps="us")
    due(d)
    for query in (ingest.cohort_hash, changes.event_counts):
        query(spark, d).count()
    assert made() == {"companies", "establishments"}
    assert rows_of(store.establishments(spark, d)) == rows_of(adapter.establishments(spark, d))
    assert rows_of(store.companies(spark, d)) == rows_of(adapter.companies(spark, d))


def test_large_snapshot_tables_are_written_in_slices(spark, tmp_path, monkeypatch):
    """of keys, each shuffled alone; together they are the table, whatever table it is."""
    d, wrote, slices = copy_of(tmp_path, monkeypatch), sinks.write_in_turn, []
    monkeypatch.setattr(store, "SLICE", 1)
    monkeypatch.setattr(sinks, "write_in_turn", lambda parts, *rest: slices.append([x.count() for x, _ in parts]) or wrote(parts, *rest))
    for name, (_, make) in store.SNAPSHOTS.items():
        rows = getattr(store, name)(spark, d)
        assert len(slices[-1]) == 2 and all(slices[-1])
        assert rows_of(rows) == rows_of(make(spark, SF).select(*rows.columns))
        assert sum(slices[-1]) == spark.read.parquet(*{x.folder for x in store.registry(spark, d, name).months(name).values()}).count()
    assert rows_of(dashboard_queries.company_state(spark, d)) == rows_of(dashboard_queries.company_state(spark, SF))


def test_shares_hold_each_key_once(spark):
    """Also keys that are null, and of any integer type."""
    rows = spark.createDataFrame([(i,) for i in (*range(200), None)], "k int")
    got = [{r.k for r in adapter.of_share(rows, "k", (i, 3)).collect()} for i in range(3)]
    assert all(len(x) > 30 for x in got) and sum(map(len, got)) == 201 and set.union(*got) == {*range(200), None}
    long = adapter.of_share(rows.select(F.col("k").cast("long")), "k", (1, 3))
    assert {r.k for r in long.collect()} == got[1]
