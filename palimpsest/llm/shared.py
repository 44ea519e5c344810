"""What the training-data operators share: table reading, checkpoints, size-checked joins."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.shipping import ship
from palimpsest.storage import checkpoint_dir as ensure_checkpoint_dir
from palimpsest.storage import setting

#: White space of all contracts here: space and the control characters 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: Rows up to which a narrow table of fixed-width keys is broadcast (some tens of MB).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with(key: str, value: str):
    def wrap(f):
        @wraps(f)
        def run(first, *args, **more):
            with setting(first if isinstance(first, SparkSession) else first.sparkSession, key, value):
                return f(first, *args, **more)

        return run

    return wrap


#: For functions of a session or a frame first: shuffle files of what they plan go as soon as it has run.
freed = _with("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
#: Likewise: what they run passes texts to Python a thousand rows at a time.
in_small_batches = _with("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def saved(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_plain(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast if it has at most limit rows, else as it is: a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def renamed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the needed columns, by internal names, so that no other column of the input can clash."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(m).alias(f"_{m}") for m in more])


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The input under names c0, c1, ... that clash with nothing, and the new name of each old one."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names
