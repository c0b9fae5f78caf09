"""The registry's stored tables: made from the given ones, published by month, refreshed where what they come from changes.

Snapshots are checked packages by month, held in spans: a row that several months of a revision have is stored once. A
snapshot table is made when it is first asked for, large ones in slices of their keys; those asked for at once are published at once. Events, issues, metrics and map observations are derived from them,
months at a time; events only once the issues have passed their gate. Every table is asked for by name. Before it is
served, the files of the given tables are looked at (at most once in FRESH_SECONDS): if they are others, snapshots are
made again, and months whose content differs from the stored package are published as a new revision. What depends on a
month is told by the commit record: a pair's changes, issues and events by the snapshots of both its months, a month's
metrics by its own, its observations also by what its addresses resolve to. Only months that are stale so are made again
and published; all others keep their files.

A build that fails or is stopped publishes nothing, and the next one starts from what is published. By default each
application has a registry of its own below the shared folder; spark.tidemark.registry names a folder that outlives it."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import digest_sums
from tidemark.operators import dashboard, diff, geo, maps, quality, spans
from tidemark.operators.contracts import COMPANIES, ESTABLISHMENTS, PARTNERS, conform
from tidemark.plans import adapter as A
from tidemark.sources import revisions as R
from tidemark.sources import sinks

#: Served tables are at most so much older than the given ones.
FRESH_SECONDS = 1.0
SNAPSHOTS = {"companies": (COMPANIES, A.companies), "establishments": (ESTABLISHMENTS, A.establishments), "partners": (PARTNERS, A.partners)}
#: What makers of rows by month make them from; other makers' rows are gathered.
SPANS = {A.companies: A.company_spans, A.establishments: A.establishment_spans, A.partners: A.partner_spans}
#: Month column and key of each table.
LAYOUTS = {
    "companies": ("competence", "cnpj_basic"), "establishments": ("competence", "cnpj"), "partners": ("competence", "cnpj_basic"), 
    "issues": ("to_month", None), "events": ("to_month", "cnpj_basic"), "metrics": ("competence", None), "resolutions": (None, None), "addresses": ("competence", None), "observations": ("competence", None), "numbers": ("competence", "cnpj_basic"), "cells": ("competence", None), "names": ("competence", "gram"),
}

#: Tables that are shuffled whole as they are written; where snapshots have more parts, they are written in slices, one for each SLICE parts.
SLICED, SLICE = ("events", "observations", "names"), 32
#: Slices that a snapshot table is written in at most, as each reads the given tables again.
MOST_SLICES = 8
#: Tables whose makers give rows in the parts that they are stored in.
PLACED = ("events",)


def _digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


class Registry:
    """The stored tables of one folder of given tables."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d, self.buckets = spark, d, A.buckets(spark, d)
        kept = spark.conf.get("spark.tidemark.registry", None)
        own = f"{sinks.work_dir(spark)}/registry-{spark.sparkContext.applicationId}"
        self.root = f"{kept or own}/{_digest([d])[:16]}-{self.buckets}"
        R.create(spark, self.root)
        self.pairs = [(p.from_month, p.to_month) for p in pairs(spark).collect()]  # a row for each month
        self.rows: dict[tuple[str, object], Row] = {}
        self.looked, self.files, self.given = None, None, None
        self.frames: dict[str, tuple] = {}
        self.schemas: dict[str, object] = {}

    def layout(self, name: str) -> R.Layout:
        month, key = LAYOUTS[name]
        place = geo.cell(F.col("latitude"), F.col("longitude")) if name == "observations" else None
        return R.Layout(month, key, self.buckets if key or place is not None else 0, place, name in SNAPSHOTS, name in PLACED, name in A.REPEATED)

    def months(self, name: str) -> dict[date, Row]:
        return {m: r for (n, m), r in self.rows.items() if n == name}

    def content(self, name: str, month: date | None) -> str:
        row = self.rows.get((name, month))
        return row.content_hash if row else ""

    def publish(self, rows: list[tuple]) -> None:
        R.commit(self.spark, self.root, rows)
        self.rows = R.active(self.spark, self.root)

    def next_revision(self) -> int:
        return 1 + max((r.revision_number for r in self.rows.values()), default=0)

    def new_folder(self, name: str) -> str:
        return f"{self.root}/{name}/revision={self.next_revision()}-{uuid.uuid4().hex[:8]}"

    def table(self, name: str, schema) -> DataFrame:
        return conform(spans.by_month(self.spans(name)), SNAPSHOTS[name][0]) if name in SNAPSHOTS else self.opened(name, schema)

    def spans(self, name: str) -> DataFrame:
        """Snapshots as they are stored, with the months that are published of each row."""
        return self.opened(name, spans.schema(SNAPSHOTS[name][0]))

    def opened(self, name: str, schema) -> DataFrame:
        """What is published of a table; months are files that don't change, so it is opened once for each state."""
        layout = self.layout(name)
        folders = {m: R.month_folder(r.folder, layout, m) for m, r in self.months(name).items() if r.folder}
        if self.frames.get(name, (None,))[0] != folders:
            self.frames[name] = (folders, R.open_table(self.spark, name, schema, layout, folders))
        return self.frames[name][1]

    def look(self, names: Iterable[str]) -> None:
        """Make those of the named snapshot tables (again) that aren't made from the given files as they are."""
        if self.looked is None or time.monotonic() - self.looked >= FRESH_SECONDS:
            tables = [f"{self.d}/{name}.parquet" for name in A.GIVEN]
            files = R.fingerprint(self.spark, [*tables, f"{self.root}/commits"])
            if files != self.files:
                self.rows = R.active(self.spark, self.root)  # this or another application has published
                self.files, self.given = files, R.fingerprint(self.spark, tables)
            self.looked = time.monotonic()
        if stale := [name for name in names if self.content(f"given_{name}", None) != self.given]:
            self.looked = None  # until they are published
            with R.shuffles_released(self.spark):
                self.take(self.given, stale)
            self.looked = time.monotonic()

    def take(self, given: str, names: list[str]) -> None:
        """Publish the months of snapshot tables that the given tables have now and the stored ones don't."""
        spark = self.spark
        by_month = lambda tables: sinks.manifest({name: conform(spans.by_month(df), SNAPSHOTS[name][0]) for name, df in tables.items()})
        had = {name: months for name in names if (months := self.months(name))}
        rows, wanted = [], {}
        if had:
            new = {(r.table_name, r.competence): r.content_hash for r in by_month({name: self.offered(name) for name in had}).collect()}  # a row for each table and month
            months = lambda pairs: spark.createDataFrame(pairs, "competence date, content_hash string")
            for name in had:
                now = [(m, h) for (n, m), h in new.items() if n == name]
                wanted[name] = [r.competence for r in diff.changed_packages(months([(m, r.content_hash) for m, r in had[name].items()]), months(now)).collect()]
                rows += [(name, m, self.next_revision(), "", 0, "", given) for m, r in had[name].items() if r.folder and (name, m) not in new]

        def write(name: str) -> None:
            slices = [spans.kept(x, spans.of_months(wanted[name])) if name in wanted else x for x in self.offered_slices(name)]
            sinks.write_snapshots(slices, SNAPSHOTS[name][0], written[name], self.layout(name))

        written = {name: self.new_folder(name) for name in names if wanted.get(name) != []}
        if written:
            # tables don't depend on each other; small ones are written at once, of large ones only one has its shuffles on disk. An error in one publishes none
            with ThreadPoolExecutor(len(written) if self.buckets <= A.BUCKETS else 1) as pool:
                list(pool.map(inheritable_thread_target(spark)(write), sorted(written, key=list(SNAPSHOTS).index, reverse=True)))
            found = by_month({name: spark.read.parquet(folder) for name, folder in written.items()}).collect()
            if {(r.table_name, r.competence): r.content_hash for r in found if r.table_name in wanted} != {(n, m): new[n, m] for n, ms in wanted.items() for m in ms}:
                raise ValueError("the given tables changed while they were read")
            rows += [(r.table_name, r.competence, self.next_revision(), written[r.table_name], r.rows, r.content_hash, given) for r in found]
        self.publish([*rows, *((f"given_{name}", None, self.next_revision(), "", 0, given, "") for name in names)])

    def offered(self, name: str, share: tuple[int, int] | None = None) -> DataFrame:
        """The snapshots that the given tables have now, in spans; all, or a share of those whose makers give spans."""
        contract, make = SNAPSHOTS[name]
        if make in SPANS:
            return SPANS[make](self.spark, self.d, share)
        return spans.gathered(conform(make(self.spark, self.d), contract))

    def offered_slices(self, name: str) -> list[DataFrame]:
        """The same in slices, so that only one has its shuffles on disk."""
        n = min(MOST_SLICES, max(1, self.buckets // SLICE)) if SNAPSHOTS[name][1] in SPANS else 1
        return [self.offered(name, (i, n) if n > 1 else None) for i in range(n)]

    def slices(self, name: str, months: list, make: Callable[[list], DataFrame]) -> Iterator[tuple[DataFrame, int]]:
        """What make gives of months, in slices with their numbers of months: some of the months, or some of one month's keys."""
        n, key = max(1, self.buckets // SLICE) if name in SLICED else 1, LAYOUTS[name][1]
        if n > 1 and key and len(months) == 1:
            made = make(months)
            yield from ((made.filter(F.pmod(F.hash(key), F.lit(n)) == i), 1) for i in range(n))
        else:
            size = -(-len(months) // n)
            yield from ((make(some), len(some)) for some in (months[i : i + size] for i in range(0, len(months), size)))

    def derived(self, name: str, sources: dict[date | None, list[str]], make: Callable[[list], DataFrame]) -> DataFrame:
        """A table whose months are made from sources (hashes); make gives the rows of the months that are stale."""
        with R.shuffles_released(self.spark):
            return self._derived(name, sources, make)

    def _derived(self, name: str, sources: dict[date | None, list[str]], make: Callable[[list], DataFrame]) -> DataFrame:
        wanted = {m: _digest(hashes) for m, hashes in sources.items()}
        stored = self.months(name)
        stale = sorted((m for m, h in wanted.items() if m not in stored or stored[m].made_from != h), key=str)
        gone = [m for m, r in stored.items() if m not in wanted and r.folder]
        if stale or gone:
            layout, number = self.layout(name), self.next_revision()
            counts, folder = {}, self.new_folder(name)
            if stale:
                self.schemas[name] = make([]).schema
                R.write_in_turn(self.slices(name, stale, make), folder, layout)
                back = self.spark.read.schema(self.schemas[name]).parquet(folder)
                per = back.groupBy(layout.month) if layout.month else back.groupBy(F.lit(None).cast("date").alias("month"))
                counts = {r[0]: r[1] for r in per.agg(F.count(F.lit(1))).collect()}  # a row for each month
            rows = [(name, m, number, folder if counts.get(m) else "", counts.get(m, 0), wanted[m], wanted[m]) for m in stale]
            self.publish([*rows, *((name, m, number, "", 0, "", "") for m in gone)])
        if name not in self.schemas:
            self.schemas[name] = make([]).schema
        return self.table(name, self.schemas[name])


_OPEN: dict[tuple, Registry] = {}


def registry(spark: SparkSession, d: str, *names: str) -> Registry:
    """The registry of d, after a look at whether the given tables are still those that the named snapshot tables (by default all) were made from."""
    key = (spark.sparkContext.applicationId, id(spark), d)
    if key not in _OPEN:
        _OPEN[key] = Registry(spark, d)
    _OPEN[key].look(names or SNAPSHOTS)
    return _OPEN[key]


def _snapshots(spark: SparkSession, d: str, name: str) -> DataFrame:
    return registry(spark, d, name).table(name, SNAPSHOTS[name][0].schema)


def stored_spans(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A snapshot table's rows of one content each, with their months."""
    return registry(spark, d, name).spans(name)


def companies(spark: SparkSession, d: str) -> DataFrame:
    return _snapshots(spark, d, "companies")


def establishments(spark: SparkSession, d: str) -> DataFrame:
    return _snapshots(spark, d, "establishments")


def partners(spark: SparkSession, d: str) -> DataFrame:
    return _snapshots(spark, d, "partners")


def pairs(spark: SparkSession) -> DataFrame:
    return diff.month_pairs(A.months(spark))


def _pairs(r: Registry, months: list[date]) -> DataFrame:
    """The pairs whose later month is one of months."""
    return r.spark.createDataFrame([p for p in r.pairs if p[1] in months], "from_month date, to_month date")


def _of_pairs(r: Registry, *names: str) -> dict[date, list[str]]:
    """Of each pair's later month the hashes of both months' snapshots."""
    return {p[1]: [r.content(n, m) for n in names for m in p] for p in r.pairs}


def _both_months(r: Registry, df: DataFrame, months: list[date]) -> DataFrame:
    """Rows of df of the pairs whose later month is one of months; files of other months aren't read."""
    return df.filter(F.col("competence").isin([m for p in r.pairs if p[1] in months for m in p]))


def window_events(spark: SparkSession, d: str) -> DataFrame:
    """All events, made again."""
    return diff.window_events(companies(spark, d), establishments(spark, d), partners(spark, d), pairs(spark), together=True)


IDENTITIES = {"companies": ["cnpj_basic"], "establishments": ["cnpj"], "partners": ["cnpj_basic", "partner_key"]}


def changed(spark: SparkSession, d: str, name: str, of: DataFrame | None = None) -> DataFrame:
    """diff.changed() of a snapshot table for pairs, by default all, read from spans."""
    return spans.changed(registry(spark, d, name).spans(name), pairs(spark) if of is None else of, IDENTITIES[name], name in A.REPEATED)


def issues(spark: SparkSession, d: str) -> DataFrame:
    """Quality issues of the window; an error if a rule's are over its limit in a month that is made."""
    r = registry(spark, d, "companies", "establishments")

    def make(months: list) -> DataFrame:
        some = _pairs(r, months)
        found = diff.missing_and_late(changed(spark, d, "companies", some), changed(spark, d, "establishments", some)).withColumn("affected_rows", F.lit(1))
        if months:
            sizes = quality.eligible({"COMPANY": _both_months(r, companies(spark, d), months), "ESTABLISHMENT": _both_months(r, establishments(spark, d), months)}, some)
            quality.enforce(quality.gate(found, sizes))
        return found

    return r.derived("issues", _of_pairs(r, "companies", "establishments"), make)


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the window, once its issues have passed their gate."""
    r = registry(spark, d)

    def make(months: list) -> DataFrame:
        if months:
            issues(spark, d)
        some = _pairs(r, months)
        people = diff.partner_events(changed(spark, d, "partners", some), diff.comparable(_both_months(r, companies(spark, d), months), some))
        # companies and partners lie in the parts that events are stored in; only establishments, which lie by their own id, go there
        places = diff.establishment_events(changed(spark, d, "establishments", some)).repartition(r.buckets, "cnpj_basic")
        return diff.company_events(changed(spark, d, "companies", some)).unionByName(places).unionByName(people)

    return r.derived("events", _of_pairs(r, "companies", "establishments", "partners"), make)


def metrics(spark: SparkSession, d: str) -> DataFrame:
    r = registry(spark, d, "companies", "establishments")
    own = lambda df, months: df.filter(F.col("competence").isin(months))
    sources = {m: [r.content("companies", m), r.content("establishments", m)] for m in r.months("establishments")}
    return r.derived("metrics", sources, lambda months: dashboard.regional_metrics(own(companies(spark, d), months), own(establishments(spark, d), months)))


def names(spark: SparkSession, d: str) -> DataFrame:
    """Postings of the names of the last month, for search."""
    r = registry(spark, d, "companies", "establishments")
    own = lambda df, months: df.filter(F.col("competence").isin(months))
    last = max(r.months("companies"), default=None)
    sources = {last: [r.content("companies", last), r.content("establishments", last)]} if last else {}
    return r.derived("names", sources, lambda months: dashboard.search_index(own(companies(spark, d), months), own(establishments(spark, d), months)))


def reference(spark, d):
    """Address candidates from the parts that suppliers ship; some parts have none, some lie far apart. Equal ones are one wherever points are told apart."""
    sold = A.table(spark, d, "lineitem").select("l_suppkey", "l_partkey").filter("l_partkey % 11 <> 0")
    part, supp, nation = F.col("l_partkey"), F.col("l_suppkey"), F.col("s_nationkey")
    far = F.when(part % 13 == 0, 900).otherwise(0)
    lat = (F.lit(-20000000) + nation * 50000 + supp % 40 * 1000 + part % 30 * 10 + part % 3 * 3 + far) / 1e6
    lon = (F.lit(-48000000) + nation * 40000 + supp % 40 * 1000 + part % 30 * 12 + part % 4 * 2 + far) / 1e6
    # candidates of one point meet while they are two keys, in tasks whose size doesn't grow with the tables; few are left of them there
    met = sold.join(A.table(spark, d, "supplier"), supp == F.col("s_suppkey")).select("l_suppkey", "l_partkey", "s_nationkey").repartition(A.buckets(spark, d), lat, lon)
    at = met.join(F.broadcast(A.nations(spark, d)), nation == F.col("n_nationkey"))
    number = lambda c: c.cast("long").cast("string")
    return at.select("ibge", number(F.lit(30000000) + supp % 40 * 100 + part % 3).alias("postal"), F.when(part % 2 == 0, "DOUTOR").otherwise("").alias("title"), F.concat(F.lit("RUA SAO "), number(supp % 40)).alias("street"), number(part % 30).alias("number"), F.concat(F.lpad(number(supp), 8, "0"), F.lpad(number(part), 8, "0")).alias("address_code"), lat.alias("latitude"), lon.alias("longitude"), (part % 6 + 1).cast("int").alias("level"))


def resolved(spark: SparkSession, d: str) -> DataFrame:
    """All addresses of the map, resolved again."""
    return geo.resolve(geo.distinct_addresses(geo.eligible(establishments(spark, d))), reference(spark, d))


def resolutions(spark: SparkSession, d: str) -> DataFrame:
    r = registry(spark, d, "establishments")
    return r.derived("resolutions", {None: [r.given, *(r.content("establishments", m) for m in sorted(r.months("establishments")))]}, lambda _: resolved(spark, d))


def _addresses(spark: SparkSession, d: str) -> None:
    """Publish of each month a hash of what its addresses resolve to, which its observations depend on. There are no rows."""
    r = registry(spark, d, "establishments")
    known = resolutions(spark, d)
    wanted = {m: _digest([r.content("resolutions", None), r.content("establishments", m)]) for m in r.months("establishments")}
    stale = [m for m, h in wanted.items() if (row := r.rows.get(("addresses", m))) is None or row.made_from != h]
    if stale:
        own = geo.with_address(geo.eligible(establishments(spark, d).filter(F.col("competence").isin(stale)))).select("competence", "fingerprint").distinct()
        each = own.join(known, "fingerprint").select("competence", F.sha2(F.to_json(F.struct(*known.columns)), 256).alias("digest"))
        with R.shuffles_released(spark):
            found = {x.competence: x.sums for x in each.groupBy("competence").agg(digest_sums(F.col("digest")).alias("sums")).collect()}  # a row for each month
        r.publish([("addresses", m, r.next_revision(), "", 0, _digest([found.get(m, "")]), wanted[m]) for m in stale])


def observations(spark: SparkSession, d: str) -> DataFrame:
    """The map's observations, each eligible row resolved or else an error."""
    r = registry(spark, d, "companies", "establishments")
    _addresses(spark, d)

    def make(months: list) -> DataFrame:
        own = lambda df: df.filter(F.col("competence").isin(months))
        places = own(establishments(spark, d))
        if months and not geo.unmatched(places, resolutions(spark, d)).isEmpty():
            raise ValueError("eligible establishments without a resolution of their address")
        return geo.observations(places, own(companies(spark, d)), resolutions(spark, d))

    return r.derived("observations", {m: [r.content(n, m) for n in ("companies", "establishments", "addresses")] for m in r.months("establishments")}, make)


def cells(spark: SparkSession, d: str) -> DataFrame:
    """The companies of the map's observations by cell, as bitmaps of their numbers within the month."""
    r = registry(spark, d, "companies", "establishments")
    seen = observations(spark, d)
    sources = {m: [r.content("observations", m)] for m in r.months("observations")}
    own = lambda df, months: df.filter(F.col("competence").isin(months))
    numbers = r.derived("numbers", sources, lambda months: maps.company_numbers(own(seen, months)))
    return r.derived("cells", sources, lambda months: maps.company_sets(own(seen, months), own(numbers, months)))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """table_name, competence and rows of the published months of all tables that have rows."""
    for table in (events, metrics, observations):
        table(spark, d)
    r = registry(spark, d)
    return R.record(spark, r.root).transform(lambda x: diff.active_revisions(x, ["table_name", "competence"])).filter("active AND rows > 0 AND competence IS NOT NULL").select("table_name", "competence", "rows")
