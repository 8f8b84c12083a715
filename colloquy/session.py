"""Session helpers shared by entry points, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow.fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("colloquy")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_PLACES: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one all executors share, as named in ``spark.checkpoint.dir``, with its scheme.

    Where the setting is absent, local sessions (tests) get a temporary folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.conf.get("spark.app.id", "session")
    if (app, found) in _PLACES:
        return _PLACES[app, found]
    base = found
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    place = f"{base.rstrip('/')}/colloquy-{app}"
    if place.startswith("file:/") and not place.startswith("file://"):
        place = "file://" + place.removeprefix("file:")
    elif "://" not in place:
        # a written file tells the scheme of the file system Spark means, for the workers' own readers
        place = f"{place}-{uuid.uuid4().hex[:8]}"
        spark.range(1).write.parquet(f"{place}/scheme")
        whole = spark.read.parquet(f"{place}/scheme").inputFiles()[0]
        place = whole[: whole.rindex("/scheme/")]
        if place.startswith("file:/") and not place.startswith("file://"):
            place = "file://" + place.removeprefix("file:")
    _PLACES[app, found] = place
    return place


def cleanup(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; results that read them must be written before."""
    key = spark.conf.get("spark.app.id", "session"), spark.conf.get("spark.checkpoint.dir", None)
    place = _PLACES.pop(key, None)
    if place:
        files, inner = pyarrow.fs.FileSystem.from_uri(place)
        if files.get_file_info(inner).type == pyarrow.fs.FileType.Directory:
            files.delete_dir(inner)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> bool:
    """Whether the files of a materialised table are still there (see ``cleanup``)."""
    places = df.inputFiles()[:1]
    return all(files.get_file_info(inner).is_file for files, inner in map(pyarrow.fs.FileSystem.from_uri, places))


def small(df: DataFrame, most: int = 10_000) -> list[Row]:
    """The rows of a dimension of fixed size; a table above ``most`` rows is refused rather than cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"expected a small dimension, found more than {most} rows")
    return rows


def fixed(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is (a shuffled join then)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions (a small table in one file), unchanged otherwise.

    Meant for work that costs far more per row than moving it; large inputs come in many partitions and never move.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that do not have it on their path (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="colloquy-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
