"""Role tables derived from the TPC-H-style driver tables.

Product = part, location = the supplier's nation. One aggregate over
``lineitem`` (``pair``: one row per product x nation) feeds every role, so
the role tables grow with ``lineitem`` and every query built on them does
real work over the whole fact table.

Plan shape (chosen for scale, left to Catalyst/AQE for the physical join):

* ``lineitem`` joins ``supplier`` on the supplier key *before* aggregating.
  ``supplier`` is a dimension; AQE broadcasts it when its measured size is
  under ``spark.sql.autoBroadcastJoinThreshold`` and falls back to a
  sort-merge join (with skew splitting) when it is not.
* The narrow lines are shuffled and then aggregated. Few of them share a part
  and a nation, so combining them before the shuffle leaves nearly as many rows,
  only wider ones, out of a hash table that spills as the tasks' input grows.
  ``pair`` deals them by part and nation, the buckets that it is staged in, and
  by year they are dealt by part alone, so that the part join moves them no
  more. The lines of a hot key stream through the few groups that it has.
* ``part`` attributes are joined *after* the aggregate: at most one row per
  part and nation reaches that join, so no key can be hot there.

Gaps come from the tables' own attributes, none from key arithmetic: a pair has
a baseline if it has lines flagged 'N' or 'A', a service level with 'R' or 'N',
a CoV if a line is not its order's first, a second scenario with 'A', and a part
has a factor from size 3 on. Every lineitem row is aggregated and every
candidate row compared, so each LEFT-join and NULL rule is exercised.
"""

from __future__ import annotations

import datetime as dt
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.sources.history import SnapshotHistory
from stocklens.sources.roles import Roles

# Fixed values of the fixture (FIXTURES.md section 3).
SNAPSHOT = dt.date(2001, 12, 31)
DECOY_SNAPSHOT = dt.date(1998, 12, 31)
SEGMENT = "ECONOMY"

BUCKETED = ("product", "location")  # columns of the staged ``pair`` that it is bucketed by


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flag_sum(flag: str, value: str) -> Column:
    return F.sum(F.when(F.col("l_returnflag") == flag, F.col(value)).otherwise(F.lit(0)))


def pair(spark: SparkSession, sf_dir: str, by_year: bool = False, parts: int | None = None) -> DataFrame:
    """``pair``: one row per (part ``p``, supplier nation ``n``); ``by_year`` also per year ``y`` of shipping.

    The lines are dealt to ``parts`` partitions. ``pair`` has ``product`` and ``location``, the names of part and nation
    in the roles, by which it is dealt; by year they are left to ``history``.
    """
    year = [F.year("l_shipdate").alias("y")] if by_year else []
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linenumber", *year
    )
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey"),
        F.col("p_type").alias("ty"),
        (F.col("p_size") / F.lit(4.0)).alias("f"),
        F.floor("p_retailprice").cast("double").alias("price"),
    )
    lines = li.join(sup, li.l_suppkey == sup.s_suppkey).select(
        F.col("l_partkey").alias("p"), F.col("s_nationkey").alias("n"), *["y"][: len(year)],
        "l_quantity", "l_returnflag", "l_linenumber",
    )
    keys = ["p", "n", *["y"][: len(year)]]
    dealt = lines.repartition(*([parts] if parts else []), *([F.col("p")] if by_year else _site()))
    if not by_year:  # named behind the shuffle, which carries the numbers alone
        keys = [*BUCKETED, *keys]
        dealt = _named(dealt)
    agg = (
        dealt
        .groupBy(*keys)
        .agg(
            _flag_sum("R", "l_quantity").alias("qr"),
            _flag_sum("A", "l_quantity").alias("qa"),
            _flag_sum("N", "l_quantity").alias("qn"),
            _flag_sum("R", "l_linenumber").alias("dr"),
            _flag_sum("A", "l_linenumber").alias("da"),
            F.sum(
                F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).otherwise(F.lit(0))
            ).alias("qt"),
            F.sum(F.col("l_linenumber") % 4).alias("b4"),
            F.sum(F.col("l_linenumber") % 3).alias("c3"),
            F.count(F.lit(1)).alias("cn"),
        )
    )
    joined = agg.join(part, agg.p == part.p_partkey).drop("p_partkey")
    return joined.select(*[c for c in joined.columns if c not in BUCKETED], *[c for c in BUCKETED if c in keys])


def _key(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _site() -> list[Column]:
    """The names of part and nation in the roles."""
    return [_key("P", "p"), _key("N", "n")]


def _named(pr: DataFrame) -> DataFrame:
    return pr.withColumns(dict(zip(BUCKETED, _site(), strict=True)))


def _candidate(pr: DataFrame, q: str, d: str, weekly_cov: Column, lt_cov: Column) -> DataFrame:
    p, n = F.col("p"), F.col("n")
    return pr.select(
        F.col("product").alias("PartName"),
        F.col("location").alias("PartSite"),
        F.col(q).cast("double").alias("Safety_StockUnits"),
        F.col(d).cast("double").alias("Safety_StockDays"),
        weekly_cov.alias("Daily_Demandweek_CoV"),
        lt_cov.alias("Daily_DemandLT_CoV"),
        ((n % 10 + 90).cast("double") / 100).alias("TargetService_Level"),
        F.col("qt").cast("double").alias("Avg_On_HandUnits"),
        F.col("cn").cast("double").alias("Daily_DemandDirect"),
        (F.col("qt") * F.col("price")).cast("double").alias("Current_On_HandCost"),
    )


def candidate(pr: DataFrame) -> DataFrame:
    p, n = F.col("p"), F.col("n")
    weekly = F.when((F.col("cn") == 1) & (p % 3 == 0), F.lit(None).cast("double")).otherwise(
        ((p * 3 + n * 5) % 20).cast("double") / 10
    )
    lt = ((p + n) % 12).cast("double") / 10
    return _candidate(pr, "qr", "dr", weekly, lt)


def candidate2(pr: DataFrame) -> DataFrame:
    p, n = F.col("p"), F.col("n")
    cov = ((p + n * 2) % 15).cast("double") / 10
    return _candidate(pr.filter(F.col("qa") > 0), "qa", "da", cov, cov)


def _in_baseline() -> Column:
    return (F.col("qn") > 0) | (F.col("qa") > 0)


def _baseline_rows(pr: DataFrame, *snapshots: Column) -> DataFrame:
    """Baseline rows of the pairs that have one, once for each of ``snapshots``."""
    p, n, f = F.col("p"), F.col("n"), F.col("f")
    ty = F.col("ty")
    null_d = F.lit(None).cast("double")

    def bucket(x: Column) -> Column:
        return x.cast("double") * f

    body = [
        F.col("product").alias("PRDID"),
        F.col("location").alias("LOCID"),
        F.when(n % 6 == 0, F.lit(0.0)).otherwise(F.col("da").cast("double")).alias(
            "IOSAFETYSTOCKDAYSOFSUPPLY"
        ),
        F.col("da").cast("double").alias("ZFINALSAFETYDAYSOFSUPPLY"),
        F.when(n % 9 == 0, null_d).otherwise(F.col("qn") * f).alias("ZRECOMMENDEDSAFETYSTOCK"),
        F.when((p + n) % 23 == 0, null_d).otherwise(F.col("qa") * f).alias("FINALIOSAFETYSTOCK"),
        (F.col("qa") * f * F.col("price")).alias("FINALIOSAFETYSTOCKVAL"),
        ty.alias("PGSUBSECTOR"),
        F.when(ty.isin("ECONOMY", "PROMO"), ty)
        .when(ty == "SMALL", F.lit("null"))
        .alias("PGTRANSITIONTYPE"),
        F.when(p % 4 == 0, null_d)
        .otherwise(((p + n * 3) % 12 + 88).cast("double") / 100)
        .alias("CFR"),
        (F.col("qt") * f).alias("SU_Total_Plant_Stock_T"),
        bucket(p % 5).alias("SU_Red_R"),
        bucket(n % 4).alias("SU_Orange_O"),
        bucket(F.col("cn") % 2).alias("SU_Anticipation_A"),
        bucket(p % 3).alias("SU_Frozen_In_Transit_F"),
        bucket(n % 3).alias("SU_Frozen_QI_Q"),
        bucket(p % 7).alias("SU_Amber_M"),
        bucket(n % 5).alias("SU_SND_Excess_D"),
        bucket(F.col("b4")).alias("SU_Situational_Safety_Brown_B"),
        bucket(p % 2).alias("SU_Launch_Excess_L"),
        (F.col("qr") * f).alias("SU_Productive_Safety_S"),
        bucket(F.col("cn") % 3).alias("SU_Excess_Y"),
        (F.col("qn") * f).alias("SU_Parameter_Driven_Cycle_P"),
        bucket(F.col("c3")).alias("SU_Situational_Cycle_C"),
        F.lit(0.0).alias("SU_Unknown_U"),
    ]
    kept = pr.filter(_in_baseline())
    out = None
    for date in snapshots:
        rows = kept.select(*body[:2], date.alias("KEYFIGUREDATE"), *body[2:])
        out = rows if out is None else out.unionByName(rows)
    return out


def baseline(pr: DataFrame) -> DataFrame:
    """Target snapshot rows plus a decoy copy at an older snapshot."""
    return _baseline_rows(pr, F.lit(SNAPSHOT), F.lit(DECOY_SNAPSHOT))


def history(by_year: DataFrame) -> DataFrame:
    """A baseline snapshot at the end of every year of shipping, of that year's lines."""
    return _baseline_rows(_named(by_year), F.make_date("y", F.lit(12), F.lit(31)))


def factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One factor per part; missing for parts of size 1 and 2, zero for one part in twenty."""
    pk = F.col("p_partkey")
    return (
        read_table(spark, sf_dir, "part")
        .filter(F.col("p_size") > 2)
        .select(
            _key("P", "p_partkey").alias("Material"),
            F.when(pk % 20 == 1, F.lit(0.0))
            .otherwise(F.col("p_size") / F.lit(4.0))
            .alias("converter_factor"),
        )
    )


def cov(pr: DataFrame) -> DataFrame:
    p, n = F.col("p"), F.col("n")
    return pr.filter(F.col("qt") > 0).select(
        F.col("product").alias("PRDID"),
        F.col("location").alias("LOCID"),
        (((p * 7 + n) % 16 + 1).cast("double") / 10).alias("CV"),
    )


def service(pr: DataFrame) -> DataFrame:
    p, n = F.col("p"), F.col("n")
    return pr.filter((F.col("qr") > 0) | (F.col("qn") > 0)).select(
        F.col("product").alias("PRDID"),
        F.col("location").alias("LOCID"),
        ((p % 10 + 90).cast("double") / 100).alias("Service_Level"),
    )


def fixture_roles(spark: SparkSession, sf_dir: str, pr: DataFrame | None = None) -> Roles:
    """All role tables, lazily, from the driver tables under ``sf_dir``.

    ``pr`` is an already computed ``pair`` table; by default it is planned
    from ``lineitem``, ``supplier`` and ``part``.
    """
    pr = pair(spark, sf_dir) if pr is None else pr
    return Roles(
        candidate=candidate(pr),
        baseline=baseline(pr),
        factor=factor(spark, sf_dir),
        cov=cov(pr),
        service=service(pr),
        candidate2=candidate2(pr),
    )


# --- staging ------------------------------------------------------------------
# Every role is a projection of ``pair``, the one aggregate over lineitem.
# Planned lazily, that aggregate would run once per role and per query.
# Staging writes ``pair`` once per source folder as parquet under the shared
# checkpoint folder (the lineage cut; the source analysis likewise saved its
# inputs as tables) and the roles become cheap projections of that file. The
# key is made of the files behind the source tables -- path, size and time of
# change, as Spark lists them, whatever the file system or form of path -- so
# changed inputs, also a part file rewritten in place, are staged again.
# ``cleanup`` deletes what was staged.
#
# The staged ``pair`` is a table bucketed by product and location, which the
# scan reports as its partitioning: the sides of the comparison, each a
# projection of it under other names, meet without being shuffled. It has one
# row per key, so no bucket holds much more than another. The number of buckets
# goes by the bytes of the source tables, one task each; what is not enough for
# two is left in plain files.

BUCKET_BYTES = 4 << 20  # of source files
MAX_BUCKETS = 100_000  # Spark's own limit

_STAGED: dict[tuple, str] = {}
_STAGE_LOCK = threading.Lock()


def _signature(spark: SparkSession, sf_dir: str) -> tuple:
    """Files, bytes and a digest of paths, sizes and times of the source tables; one row, however many files."""
    paths = [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "supplier", "part")]
    files = spark.read.format("binaryFile").load(paths).select("path", "length", F.col("modificationTime").cast("double").alias("t"))
    digest = F.sum(F.xxhash64("path", "length", "t").cast("decimal(38,0)"))
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), digest).first())


def _parts(signature: tuple) -> int:
    """Partitions for the lines of source files of so many bytes."""
    return min(max(1, -(-(signature[1] or 0) // BUCKET_BYTES)), MAX_BUCKETS)


def _table(path: str) -> str:
    """The catalog's name of the table staged in ``path``."""
    return f"spark_catalog.default.stocklens_{path.rsplit('/', 1)[1].replace('-', '_')}"


def staged_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair`` for ``sf_dir``, computed and written once, in buckets, then read back."""
    from stocklens.session import app_id, scratch_path

    signature = _signature(spark, sf_dir)
    key = (app_id(spark), sf_dir, signature)
    with _STAGE_LOCK:
        path = _STAGED.get(key)
        if path is None:
            path, parts = scratch_path(spark, "pair"), _parts(signature)
            rows = pair(spark, sf_dir, parts=parts)
            if parts == 1:
                rows.write.parquet(path)
            else:
                # dealt by the buckets' own hash, so a task writes one bucket, in one file; Spark drops this exchange
                # where the part join left the rows as they were dealt
                rows = rows.repartition(parts, *BUCKETED)
                rows.write.format("parquet").bucketBy(parts, *BUCKETED).option("path", path).saveAsTable(_table(path))
            _STAGED[key] = path
    return spark.table(_table(path)) if _parts(signature) > 1 else spark.read.parquet(path)


def staged_history(spark: SparkSession, sf_dir: str) -> SnapshotHistory:
    """``history`` for ``sf_dir``, partitioned by its date, written once.

    The rows are dealt to the files by year while they are narrow, before the baseline's columns are made of them.
    """
    from stocklens.session import app_id, scratch_path

    signature = _signature(spark, sf_dir)
    key = (app_id(spark), sf_dir, "history", signature)
    with _STAGE_LOCK:
        path = _STAGED.get(key)
        if path is None:
            path = scratch_path(spark, "history")
            rows = pair(spark, sf_dir, by_year=True, parts=_parts(signature)).filter(_in_baseline())
            SnapshotHistory.write(history(rows.hint("rebalance", F.col("y"))), path, dealt=True)
            _STAGED[key] = path
    return SnapshotHistory(spark, path)


def cleanup(spark: SparkSession) -> int:
    """Delete this application's staged tables; the number of them."""
    from stocklens.session import app_id

    with _STAGE_LOCK:
        mine = [k for k in _STAGED if k[0] == app_id(spark)]
        for k in mine:
            staged = _STAGED.pop(k)
            spark.sql(f"DROP TABLE IF EXISTS {_table(staged)}")  # external: the files go with the folder
            path = spark._jvm.org.apache.hadoop.fs.Path(staged)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(mine)


def staged_roles(spark: SparkSession, sf_dir: str) -> Roles:
    """Role tables over the staged ``pair`` of ``sf_dir``."""
    return fixture_roles(spark, sf_dir, staged_pair(spark, sf_dir))
