"""Session helpers: defaults for local runs, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "lodestack", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects. On a cluster pass your own session instead."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local does a temporary folder stand in; on a
    cluster without the setting this raises, as a machine-local folder would not survive there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if "LODESTACK_LOCAL_DIR" not in os.environ:
        os.environ["LODESTACK_LOCAL_DIR"] = tempfile.mkdtemp(prefix="lodestack-")
        atexit.register(shutil.rmtree, os.environ["LODESTACK_LOCAL_DIR"], ignore_errors=True)
    return f"file://{os.environ['LODESTACK_LOCAL_DIR']}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the plan before it is never run again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def clear_cuts(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` has written in this process, once the results that read them are written; how many there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return done


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, wherever the driver was started."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_lodestack_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lodestack-")) / "lodestack.zip"
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)  # the driver serves it as long as it runs
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._lodestack_shipped = True
