"""Sources by name, with their loaders, and a runner from a saved widget to a result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from quillboard.errors import Err, ErrorKind, Failure, Ok, attempt
from quillboard.functions import dates
from quillboard.plans import spec as Q
from quillboard.plans.compile import execute
from quillboard.plans.validate import check_payload
from quillboard.schema import FieldDef, FieldType, SourceDef
from quillboard.sources.cache import SnapshotCache

Loader = Callable[[SparkSession, dates.Range | None], DataFrame]


class Catalog:
    """Declared sources and how their frames are loaded; loaders may use or ignore the date bound."""

    def __init__(self) -> None:
        self._sources: dict[str, SourceDef] = {}
        self._loaders: dict[str, Loader] = {}

    def register(self, source: SourceDef, loader: Loader) -> Catalog:
        self._sources[source.source_id] = source
        self._loaders[source.source_id] = loader
        return self

    @property
    def sources(self) -> Sequence[SourceDef]:
        return tuple(self._sources.values())

    def source(self, source_id: str) -> SourceDef | None:
        return self._sources.get(source_id)

    def load(self, spark: SparkSession, source_id: str, bound: dates.Range | None = None) -> DataFrame:
        if source_id not in self._loaders:
            raise Failure(ErrorKind.unknownSource, f"no source {source_id}")
        return self._loaders[source_id](spark, bound)

    def snapshots(self, spark: SparkSession, persist: bool = True) -> SnapshotCache:
        """A cache of this catalog's sources, by source and days."""
        return SnapshotCache(lambda source_id, bound: self.load(spark, source_id, bound), persist)

    def run(self, spark: SparkSession, query: Q.Query, **how) -> Ok | Err:
        def work():
            frame = self.load(spark, query.source)
            return execute(query, frame, self.sources, **how)

        found = attempt(work)
        return found if found.is_err else found.value

    def run_payload(self, spark: SparkSession, payload: Q.Single | Q.Paired, mode: dates.DateRangeMode, page: dates.DateRange | None, today: datetime, as_of: datetime | None = None, earliest: datetime | None = None, densify: bool = True, cache: SnapshotCache | None = None) -> Ok | Err:
        """Check, resolve the range, project it into filters, load, execute. Ok holds one result or a pair.

        A cache (`snapshots`) shares loaded sources between both halves of a pair and between widgets.
        """
        load = cache.get if cache is not None else lambda source_id, bound: self.load(spark, source_id, bound)

        def work():
            check_payload(payload, self.sources, mode)
            bound = dates.resolve_mode(mode, page, today, earliest)
            found = []
            for query in (payload.query,) if isinstance(payload, Q.Single) else (payload.x, payload.y):
                projected = dates.project(query, mode, self.sources, page, today, earliest)
                ran = projected.and_then(lambda q: execute(q, load(q.source, bound), self.sources, as_of=as_of, date_range=bound, densify=densify))
                if ran.is_err:
                    raise Failure(ran.error.kind, ran.error.message, ran.error.field)
                found.append(ran.value)
            return found[0] if isinstance(payload, Q.Single) else tuple(found)

        return attempt(work)


def source(source_id: str, primary_date: str | None = None, **fields: FieldType) -> SourceDef:
    """A source whose fields may be used for everything."""
    return SourceDef(source_id, source_id, tuple(FieldDef(name, source_id, name, t) for name, t in fields.items()), primary_date)


S, E, I, D, TS = FieldType.string, FieldType.enumeration, FieldType.integer, FieldType.double, FieldType.dateTime
#: The star-schema tables that the registered queries read.
TABLES = (
    source("events", "ts", event_id=I, ts=TS, user_id=I, event_type=E, value=D),
    source("orders", "o_orderdate", o_orderkey=I, o_custkey=I, o_orderstatus=E, o_totalprice=D, o_orderdate=TS, o_orderpriority=E),
    source("lineitem", "l_shipdate", l_orderkey=I, l_partkey=I, l_suppkey=I, l_linenumber=I, l_quantity=D, l_extendedprice=D, l_discount=D, l_tax=D, l_returnflag=E, l_linestatus=E, l_shipdate=TS),
    source("customer", None, c_custkey=I, c_nationkey=I, c_name=S, c_acctbal=D, c_mktsegment=E),
    source("part", None, p_partkey=I, p_brand=E, p_type=E, p_size=I, p_retailprice=D),
    source("supplier", None, s_suppkey=I, s_nationkey=I, s_name=S, s_acctbal=D),
    source("nation", None, n_nationkey=I, n_regionkey=I, n_name=S),
    source("region", None, r_regionkey=I, r_name=S),
)


def tables(sf_dir: str) -> Catalog:
    """The star-schema tables as Parquet files in one folder."""
    catalog = Catalog()
    for s in TABLES:
        catalog.register(s, lambda spark, bound, name=s.source_id: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return catalog
