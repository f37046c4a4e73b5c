"""Session settings and the shared storage root."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins and shuffle sizes from
# runtime statistics and splits skewed join partitions.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A shuffle join hashes its small side, and does not sort the large one, where every
    # partition of the small side is measured to be below this.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "static",
    "spark.sql.parquet.filterPushdown": "true",
    # Aggregates over partition columns only (the newest month, for the
    # default run date) are answered from the folder listing, with no file
    # opened.  Safe here: partitioned writes never leave an empty month folder.
    "spark.sql.optimizer.metadataOnly": "true",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8,
                  app: str = "ledgerlake", extra_conf: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and the bench (one JVM, `cores` threads)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in {**SESSION_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to an existing session."""
    for k, v in SESSION_CONF.items():
        if k.startswith("spark.ui."):
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: leave it
            pass


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a shared file system).  Only a local-mode
    session without the setting gets a folder of its own, as in tests.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.conf.get("spark.checkpoint.dir")
        except Exception:
            root = None
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = os.path.join(tempfile.gettempdir(), f"ledgerlake-{os.getuid()}",
                            "checkpoints")
        os.makedirs(root, exist_ok=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def _code_fingerprint() -> str:
    """Hash of the code that defines the landed tables: a change to it gives
    a new store folder, so stale derived data is never reused."""
    here = os.path.dirname(os.path.abspath(__file__))
    h = hashlib.sha1()
    for rel in ("constants.py", "sources/fixtures.py", "sources/store.py",
                "functions/columns.py"):
        with open(os.path.join(here, rel), "rb") as f:
            h.update(f.read())
    return h.hexdigest()[:10]


STORE_VERSION = _code_fingerprint()


STORE_TAG_CONF = "spark.ledgerlake.storeTag"


def store_dir(spark: SparkSession, sf_dir: str) -> str:
    """Folder for the tables this library derives from one input folder.

    A session may set ``spark.ledgerlake.storeTag`` to keep its own copy
    (the bench does, so its forced reload never rewrites files another job
    is reading)."""
    try:
        tag = spark.conf.get(STORE_TAG_CONF)
    except Exception:
        tag = ""
    key = hashlib.sha1(f"{STORE_VERSION}:{tag}:{os.path.abspath(sf_dir)}".encode()).hexdigest()[:12]
    return f"{checkpoint_root(spark)}/ledgerlake-store/{key}"


def cluster_conf(input_bytes: int, executor_cores: int, executors: int,
                 target_partition_bytes: int = 128 * 1024 * 1024) -> dict[str, str]:
    """Settings sized to the data for a cluster run.

    Shuffles start with enough partitions for ~``target_partition_bytes``
    each (at least 2 waves of the cluster's cores) and AQE coalesces them to
    the advisory size at run time, so a partition fits an executor's memory
    at any scale; scans split files at the same size.
    """
    cores = executor_cores * executors
    parts = max(2 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        **{k: v for k, v in SESSION_CONF.items() if not k.startswith("spark.ui.")},
    }
