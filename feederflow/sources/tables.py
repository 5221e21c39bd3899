"""Networks from folders of CSV or Parquet tables, and results back to CSV.

Component tables are small and are read through Spark, so any store will do, then checked and coerced row by row on
the driver, where an error can name its file and row. Profiles are long in time and stay in Spark.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feederflow.network import COMPONENTS, KEYS, SERIES, Globals, Network, if_small
from feederflow.operators.reductions import lengthen, widen
from feederflow.sources.draft import SourceError

YES, NO = {"true", "t", "yes", "y", "1"}, {"false", "f", "no", "n", "0"}
#: The globals that a folder states in a text file of their own.
LIMITS = ("co2_price", "co2_limit", "water_limit", "land_limit")
#: Columns that name another component in a source and hold its number here.
REFERENCES = ("bus_id", "bus0", "bus1", "downstream_id")
DEFAULTS = {"gen_availability": 1.0, "load_profile": None, "storage_inflow": 0.0}


def parse_csv(text: str, label: str) -> list[dict[str, str]]:
    """Rows by lower-cased header; blank lines go, short rows are padded, long rows are errors."""
    lines = [r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
    if not lines:
        return []
    header = [h.strip().lower() for h in lines[0]]
    out = []
    for k, r in enumerate(lines[1:], start=1):
        if len(r) > len(header):
            raise SourceError(f"{label} row {k}: {len(r)} fields under {len(header)} headings")
        out.append(dict(zip(header, [*(c.strip() for c in r), *[""] * (len(header) - len(r))], strict=True)))
    return out


def tranches(text: str) -> list[tuple[float, float]]:
    """``mw@value`` pairs after semicolons; malformed ones and those without power are skipped."""
    out = []
    for part in text.split(";"):
        mw, at, value = part.partition("@")
        try:
            pair = (float(mw), float(value))
        except ValueError:
            continue
        if at and pair[0] > 0:
            out.append(pair)
    return out


def coerce(row: dict, name: str, kind: str, default, where: str):
    """A cell as its type: blank or absent is the default, anything unreadable an error."""
    raw = row.get(name)
    if raw is None or (isinstance(raw, str) and not raw.strip()):
        return default
    if not isinstance(raw, str):
        raw = str(raw)
    try:
        if kind == "double":
            return float(raw)
        if kind in ("int", "bigint"):
            return int(float(raw))
        if kind == "boolean":
            if raw.lower() not in YES | NO:
                raise ValueError
            return raw.lower() in YES
        if kind.startswith("array"):
            return tranches(raw)
    except (ValueError, OverflowError):
        raise SourceError(f"{where}: {name} is {raw!r}") from None
    return raw


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, without reading it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def text_of(spark: SparkSession, path: str) -> str | None:
    """A small text file, or the parts of a written one."""
    if not exists(spark, path):
        return None
    parts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()
    return "".join(r["value"] for r in sorted(parts))


def assemble(spark: SparkSession, table, notes=(), limits: dict | None = None) -> Network:
    """A network from ``table(name) -> rows by header or None``: numbers keys in order and resolves names."""
    rows: dict[str, list[dict]] = {}
    for name in ("buses", "generators", "lines", "loads", "storage_units", "links"):
        got = table(name)
        if got is None:
            if name == "buses":
                raise SourceError("buses: the table is missing")
            continue
        own = [c for c in COMPONENTS[name] if c[0] not in REFERENCES and c[0] != KEYS[name]]
        rows[name] = [{n: coerce(r, n, t, d, f"{name} row {k}") for n, t, d in own} | {"_raw": r} for k, r in enumerate(got, start=1)]
    number = {r["name"]: k for k, r in enumerate(rows["buses"])}  # of a repeated name the last

    def bus(r: dict, column: str, where: str) -> int:
        name = str(r["_raw"].get(column) or "")
        if name not in number:
            raise SourceError(f"{where}: no bus is called {name!r}")
        return number[name]

    if all(not (r["x"] or 0) and not (r["y"] or 0) for r in rows["buses"]):  # all at 0, 0: no positions at all
        for r in rows["buses"]:
            r["x"] = r["y"] = None
    stores = {r["name"]: k for k, r in enumerate(rows.get("storage_units", []))}
    for name, items in rows.items():
        for k, r in enumerate(items):
            where = f"{name} row {k + 1}"
            r[KEYS[name]] = k
            if name in ("lines", "links"):
                r["bus0"], r["bus1"] = bus(r, "bus0", where), bus(r, "bus1", where)
            elif name != "buses":
                r["bus_id"] = bus(r, "bus", where)
            if name == "storage_units" and (down := str(r["_raw"].get("downstream") or "")):
                if down not in stores:
                    raise SourceError(f"{where}: no storage unit is called {down!r}")
                r["downstream_id"] = stores[down]
            del r["_raw"]
    weights = table("snapshots")
    rows["snapshots"] = [{"t": t, "weight": coerce(r, "weight", "double", 1.0, f"snapshots row {t + 1}")} for t, r in enumerate(weights or [{}])]
    return Network.of(spark, Globals(**(limits or {})), notes, **rows)


def in_file_order(df: DataFrame) -> DataFrame:
    """``df``, a scan of files, with its rows numbered as ``t``: files by name, then rows as they stand.

    A row's number is its place in its piece of a file after the rows of all pieces before, so no task sees all rows.
    """
    piece = ["_file", "_at"]
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i"))
    ahead = Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(*piece).agg(F.count("*").alias("_n")).select(*piece, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*piece).orderBy("_i")) - 1
    return df.withColumn("_p", place).join(if_small(before), piece).withColumn("t", (F.col("_before") + F.col("_p")).cast("int")).drop(*piece, "_i", "_p", "_before")


def with_profiles(net: Network, wide) -> Network:
    """``net`` with the series that ``wide(name) -> DataFrame or None`` has: by a column ``t`` if there is one that no
    component is called, else in the order of their rows."""
    n = net["snapshots"].count()
    for series in ("gen_availability", "load_profile", "storage_inflow"):
        df = wide(series)
        if df is None:
            continue
        table, key = SERIES[series]
        names = net[table].select(key, "name")
        if "t" not in df.columns or not names.where("lower(name) = 't'").isEmpty():
            df = in_file_order(df.withColumnRenamed("t", "T") if "t" in df.columns else df)
        df = df.withColumn("t", F.col("t").cast("int"))
        if (have := df.count()) != n:
            raise SourceError(f"{series}: {have} rows for {n} snapshots")
        df = df.select("t", *[F.col(f"`{c}`").cast("double").alias(c) for c in df.columns if c != "t"])
        net = net.with_tables(**{series: lengthen(df, names, key, DEFAULTS[series])})
    return net


def load_csv(spark: SparkSession, folder: str) -> Network:
    limits = {k: float(v) for k in LIMITS if (v := text_of(spark, f"{folder}/{k}.txt")) is not None}

    def table(name):
        text = text_of(spark, f"{folder}/{name}.csv")
        return None if text is None else parse_csv(text, f"{name}.csv")

    def wide(name):
        path = f"{folder}/{name}.csv"
        return spark.read.csv(path, header=True, quote='"', escape='"', enforceSchema=False) if exists(spark, path) else None

    return with_profiles(assemble(spark, table, limits=limits), wide)


def load_parquet(spark: SparkSession, folder: str) -> Network:
    """The same tables as Parquet files; only the columns that are used are read."""

    def frame(name):
        return spark.read.parquet(f"{folder}/{name}.parquet") if exists(spark, f"{folder}/{name}.parquet") else None

    def table(name):
        df = frame(name)
        if df is None:
            return None
        wanted = {c for c, _, _ in COMPONENTS[name]} | {"bus", "bus0", "bus1", "downstream"}
        df = df.select(*[c for c in df.columns if c.lower() in wanted])
        df = df.orderBy("t") if name == "snapshots" and "t" in df.columns else df
        return [{k.lower(): v for k, v in r.asDict(recursive=True).items()} for r in df.collect()]

    def numeric(name):
        """Series are numbers and match names by case; columns of no component are left out."""
        df = frame(name)
        if df is None:
            return None
        known = {r["name"] for r in net[SERIES[name][0]].select("name").collect()} | {"t"}
        kept = [c for c in df.columns if c in known]
        if wrong := [c for c, t in df.dtypes if c in kept and t not in ("double", "float", "bigint", "int")]:
            raise SourceError(f"{name}: column {wrong[0]} is no number")
        return df.select(*kept)

    net = assemble(spark, table)
    return with_profiles(net, numeric)


def bus_names(net: Network, df: DataFrame, table: str = "") -> DataFrame:
    """``df`` with the names of buses, and of a reservoir's downstream one, in place of their keys."""
    names = net["buses"].select(F.col("bus_id").alias("_id"), F.col("name").alias("_name"))
    for key, out in (("bus_id", "bus"), ("bus0", "bus0"), ("bus1", "bus1")):
        if key in df.columns and table != "buses":
            df = df.join(if_small(names), F.col(key) == F.col("_id")).drop(key, "_id").withColumnRenamed("_name", out)
    if table == "storage_units" and "downstream_id" in df.columns:
        down = net["storage_units"].select(F.col("storage_id").alias("_id"), F.col("name").alias("downstream"))
        df = df.join(if_small(down), F.col("downstream_id") == F.col("_id"), "left").drop("_id", "downstream_id")
    return df


def write_table(df: DataFrame, path: str) -> None:
    """A small table as one CSV file; quotes within a field are doubled, as :func:`parse_csv` reads them."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def tranche_text(c: str):
    """``mw@value`` pairs with semicolons between them, as :func:`tranches` reads them."""
    return F.array_join(F.transform(F.col(c), lambda x: F.concat_ws("@", x["mw"].cast("string"), x["value"].cast("string"))), ";")


def _as_text(df: DataFrame) -> DataFrame:
    """Columns as a CSV table holds them: infinite numbers by name, tranches as pairs."""

    def say(c: str, kind: str):
        col = F.col(c)
        if kind == "double":
            return F.when(col == float("inf"), "inf").when(col == float("-inf"), "-inf").otherwise(col.cast("string"))
        if kind.startswith("array"):
            return tranche_text(c)
        return col.cast("string")

    return df.select(*[say(c, t).alias(c) for c, t in df.dtypes])


def write_csv(net: Network, folder: str) -> None:
    """The network as a folder that :func:`load_csv` reads; each table is one small file."""
    for table in KEYS:
        if table in net.tables:
            write_table(_as_text(bus_names(net, net[table], table).orderBy(KEYS[table]).drop(KEYS[table])), f"{folder}/{table}.csv")
    write_table(net["snapshots"].orderBy("t").select("weight"), f"{folder}/snapshots.csv")
    for name in LIMITS:
        if (value := getattr(net.settings, name)) is not None:
            net.spark.createDataFrame([(str(value),)], "v string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.txt")
    for series in ("gen_availability", "load_profile", "storage_inflow"):
        if series in net.tables:
            table, key = SERIES[series]
            write_table(widen(net[series], net[table], key, digits=12).orderBy("t").drop("t"), f"{folder}/{series}.csv")


def write_results(net: Network, series: dict[str, tuple[DataFrame, str]], folder: str, built: DataFrame | None = None) -> None:
    """Solved series ``{file: (long series, table)}``, wide and to six places, and ``built(kind, name, mw)`` as ``capacity.csv``."""
    for name, (df, table) in series.items():
        write_table(widen(df, net[table], KEYS[table]).orderBy("t"), f"{folder}/{name}.csv")
    if built is not None:
        write_table(built.select("kind", "name", F.format_number("mw", "0.000000").alias("mw")).orderBy("kind", "name"), f"{folder}/capacity.csv")
