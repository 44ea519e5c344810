"""Relations between blocks: neighbours, heuristic extraction, validation of proposed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions import text as T
from palimpsest.functions import words
from palimpsest.sources.config import DEFAULT, Config
from palimpsest.storage import durable

from . import history
from .seal import event_text

_KEY = ("src", "dst", "type")


def neighbors(blocks: DataFrame, k: int) -> DataFrame:
    """block_id, other, score, rank: the k earlier blocks of the session that are nearest in keywords and time."""
    return history.nearest(blocks, k)


def strongest(relations: DataFrame) -> DataFrame:
    return relations.groupBy(*_KEY).agg(F.max("confidence").alias("confidence"))


def normalized(relations: DataFrame, min_confidence: float = 0.35, allowed: list[str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Types by alias (exact or upper-cased key), trimmed ends, confidence within 0 and 1 and at least the minimum; the strongest of each key."""
    aliases = words.RELATION_ALIASES if aliases is None else aliases
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    kind = F.trim(F.coalesce(table[F.col("type")], table[F.upper("type")], F.col("type")))
    x = relations.select(F.trim("src").alias("src"), F.trim("dst").alias("dst"), kind.alias("type"), S.clamp(F.col("confidence")).alias("confidence"))
    x = x.filter((F.col("type") != "") & ((F.col("src") != "") | (F.col("dst") != "")) & (F.col("confidence") >= min_confidence))
    return strongest(x.filter(F.col("type").isin(allowed)) if allowed else x)


def validated(proposed: DataFrame, current: Column | str = "current_id") -> DataFrame:
    """Proposed relations (src, dst, type, confidence) that hold: a type, an endpoint, and one of a file for file types.

    Missing src is empty, missing dst the current block; missing or NaN confidence is 0.5.
    """
    c = F.col(current) if isinstance(current, str) else current
    conf = F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0.5).otherwise(S.clamp(F.col("confidence")))
    x = proposed.select(F.trim(F.coalesce("src", F.lit(""))).alias("src"), F.trim(F.coalesce("dst", c)).alias("dst"), F.trim(F.coalesce("type", F.lit(""))).alias("type"), conf.alias("confidence"))
    file = lambda e: F.startswith(F.col(e), F.lit("file:")) | F.startswith(F.col(e), F.lit("snapshot:"))
    ok = (F.col("type") != "") & ((F.col("src") != "") | (F.col("dst") != "")) & (~F.col("type").isin(*words.FILE_TYPES) | file("src") | file("dst"))
    return strongest(x.filter(ok))


def extract(blocks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """src, dst, type, confidence: what a block's text and times say about its neighbours.

    Text is the summary and the events a block still holds.  Context edges are the strongest of each
    block, six at most.
    """
    text = T.normalize(F.concat_ws(" ", "summary", event_text("raw_events")))
    hints = {"cause": words.CAUSE, "outcome": words.OUTCOME, "trigger": words.TRIGGER, "subtask": words.SUBTASK, "task": words.TASK, "alternative": words.ALTERNATIVE}
    # What a text says is worked out once a block; pairs carry flags and keywords, no texts.
    own = blocks.select("block_id", "start_ms", "end_ms", text.alias("_t")).withColumn("kw", T.keywords("_t", 12))
    own = durable(own.select("block_id", "start_ms", "end_ms", "kw", *[T.contains_any(F.col("_t"), h).alias(name) for name, h in hints.items()]))
    near = neighbors(blocks, cfg.semantic_top_k)
    x = near.select("block_id", "other").join(own, "block_id")
    old = {"block_id": "other", "end_ms": "o_end", "kw": "o_kw", "trigger": "o_trigger", "subtask": "o_subtask", "task": "o_task"}
    x = x.join(own.select(*[F.col(c).alias(o) for c, o in old.items()]), "other")
    shared = F.size(F.array_intersect("kw", "o_kw")) / F.greatest(F.size("kw"), F.size("o_kw"), F.lit(1))
    flags = ["cause", "outcome", "subtask", "task", "alternative", "o_trigger", "o_subtask", "o_task"]
    x = x.select("block_id", "other", "end_ms", "o_end", *flags, shared.alias("l"), S.recency_relation(F.col("start_ms"), F.col("o_end")).alias("r"), F.count("*").over(Window.partitionBy("block_id")).alias("n"))
    l, r = F.col("l"), F.col("r")  # noqa: E741
    rel = lambda kind, conf, cond: F.when(cond, F.struct(F.lit(kind).alias("type"), S.clamp(conf).alias("confidence")))
    last = F.row_number().over(Window.partitionBy("block_id").orderBy((F.col("o_end") > F.col("end_ms")), F.desc("o_end"), "other")) == 1
    x = x.withColumn("previous", last & (F.col("o_end") <= F.col("end_ms")))
    found = F.array_compact(F.array(
        rel("FOLLOWS", 0.55 + r * 0.4, F.col("previous")),
        rel("CAUSES", 0.45 + l * 0.35 + r * 0.2, F.col("cause") & F.col("outcome") & (F.col("o_trigger") | (l >= 0.2))),
        rel("PARENT_TASK", 0.5 + l * 0.3 + r * 0.2, F.col("subtask") & F.col("o_task")),
        rel("CHILD_TASK", 0.45 + l * 0.35 + r * 0.2, F.col("task") & F.col("o_subtask")),
        rel("ALTERNATIVE", 0.4 + l * 0.4 + r * 0.2, F.col("alternative") & (l >= 0.15)),
        rel("CONTEXT", l * 0.75 + r * 0.25, l * 0.75 + r * 0.25 >= 0.18),
    ))
    e = x.select("block_id", "other", "n", F.explode(found).alias("e")).select(F.col("other").alias("src"), F.col("block_id").alias("dst"), "e.type", "e.confidence", "n")
    place = F.row_number().over(Window.partitionBy("dst", "type").orderBy(F.desc("confidence"), "src"))
    most = F.greatest(F.lit(2), F.least(F.lit(6), F.ceil(F.col("n") * 0.6)))
    e = e.withColumn("_p", place).filter((F.col("type") != "CONTEXT") | (F.col("_p") <= most))
    return strongest(e)


def file_links(blocks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges of files that blocks mention (block_id, path, version): snapshot to file, and file to a block there is."""
    file, snapshot = F.concat(F.lit("file:"), "path"), F.concat(F.lit("snapshot:"), "path", F.lit("#"), "version")
    own = mentions.filter("path <> ''").select(snapshot.alias("src"), file.alias("dst"), F.lit("SNAPSHOT_OF_FILE").alias("type"), F.lit(1.0).alias("confidence"))
    known = mentions.filter("path <> ''").join(blocks.select("block_id"), "block_id", "left_semi")
    return strongest(own.unionByName(known.select(file.alias("src"), F.col("block_id").alias("dst"), F.lit("FILE_MENTIONS_BLOCK").alias("type"), F.lit(0.75).alias("confidence"))))
