"""Document fingerprints: SimHash with permuted block tables.  Built-in functions only.

Terms are lower-cased words, weighed by their length and by how often they occur; each term's 64-bit hash
votes on 64 signed bits.  The votes of a document are summed in the map task, two counters to a long, so
one narrow row a document is shuffled.

To find fingerprints within a Hamming radius, a fingerprint is cut into blocks; each table leaves out as
many blocks as the radius has bits and keys on the others, which two near fingerprints share in one table
at least.  A key that very many fingerprints share goes on to tables with more and smaller blocks, in
which a key bounds the number of fingerprints.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, renamed, saved, small_or_plain

BITS, RADIUS = 64, 3
#: Documents of a block when each is to meet its successor, and parts into which quantiles cut a range of ids at a time.
BLOCK, QUANTILES = 1000, 64
#: Fingerprints under one key of the first tables beyond which they go to finer ones.
CROWD = 2000
_PAIR = 0x0000000100000001
_HEAVIEST = 12


def _weight(word: Column) -> Column:
    """A word counts by its length, which stands in for its rarity; the empty string does not count."""
    n = F.octet_length(word)
    return F.when(n == 0, 0).otherwise(F.greatest(n - 2, F.lit(1)) * F.least(n, F.lit(_HEAVIEST))).cast("long")


def _votes(use: Column, weight: Column, h: Column, name: str) -> list[Column]:
    """Sums for bit i and bit i + 32 in one long each, and the sum of weights."""
    w = F.when(use, weight).otherwise(F.lit(0).cast("long"))
    return [F.sum(w * F.shiftright(h, i).bitwiseAND(F.lit(_PAIR))).alias(f"{name}{i}") for i in range(32)] + [F.sum(w).alias(f"{name}w")]


def _print(name: str) -> Column:
    """The fingerprint: a bit is set if over half of the weight votes for it."""
    bits = None
    for i in range(32):
        low = F.col(f"{name}{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(F.col(f"{name}{i}"), 32)
        for x, at in ((low, i), (high, i + 32)):
            bit = F.shiftleft(F.when(2 * x > F.col(f"{name}w"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")), at)
            bits = bit if bits is None else bits.bitwiseOR(bit)
    return bits


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (long) of every row; null and wordless texts have fingerprint 0; repeated rows stay as many."""
    rows = renamed(docs, id_col, text_col).select("_id", F.coalesce("_text", F.lit("")).alias("_text"))
    terms = rows.select("_id", F.xxhash64("_text").alias("_h"), _marked(("_text", True, True)).alias("_p"))
    return _counted(_summed(terms, ["_id", "_h"], edited=False)).select(F.col("_id").alias(id_col), _print("a").alias("fp"))


def _marked(*parts) -> Column:
    """An array of (text, in the original, in the edited, row) with a last entry that counts the row."""
    entry = lambda t, a, b, m: F.struct(t.alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(m).alias("m"))
    return F.explode(F.array(*[entry(F.col(c), a, b, 0) for c, a, b in parts], entry(F.lit(""), False, False, 1)))


def _summed(parts: DataFrame, keys: list[str], edited: bool) -> DataFrame:
    words = parts.select(*keys, "_p.a", "_p.b", "_p.m", F.explode(F.split(F.lower("_p.t"), SPACES)).alias("_w"))
    words = words.select(*keys, "a", "b", "m", F.xxhash64("_w").alias("_x"), _weight(F.col("_w")).alias("_wt"))
    sums = _votes(F.col("a"), F.col("_wt"), F.col("_x"), "a") + (_votes(F.col("b"), F.col("_wt"), F.col("_x"), "b") if edited else [])
    return words.groupBy(*keys).agg(*sums, F.sum("m").alias("_rows"))


def _counted(sums: DataFrame) -> DataFrame:
    """Rows that are alike in all keys were summed as one, which leaves the signs as they are; here they are many again."""
    return sums.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))).drop("_again")


def _placed(rows: DataFrame) -> DataFrame:
    """rows (_id, _text) with _o, _h and _block: some BLOCK rows each, in ascending order of (_id, _h), nulls first.

    Quantiles of all ids, then of the ids within each of these parts, and once more, so that clustered ids
    fill as many blocks as spread ones.  An id that many rows share, null too, is cut by the hash of the text.
    """
    rows = rows.withColumns({"_o": F.coalesce("_id", F.lit(-(1 << 63))), "_h": F.xxhash64("_text")})
    n, keys = rows.count(), ["_k0", "_k1", "_k2"]
    cuts = F.percentile_approx("_o", [i / QUANTILES for i in range(1, QUANTILES)], 1000).alias("_cuts")
    place = lambda c: F.size(F.filter(c, lambda x: x <= F.col("_o")))
    first = rows.agg(cuts).first()[0] or []
    rows = rows.withColumn("_k0", place(F.array(*[F.lit(x).cast("long") for x in first])))
    for level in (1, 2):
        if n > BLOCK * QUANTILES**level:  # the parts are QUANTILES ** level at most
            rows = rows.join(F.broadcast(saved(rows.groupBy(*keys[:level]).agg(cuts))), keys[:level]).withColumn(keys[level], place("_cuts")).drop("_cuts")
        else:
            rows = rows.withColumn(keys[level], F.lit(0))
    often = saved(rows.groupBy(*keys, "_o").count().filter(F.col("count") > BLOCK))
    sub = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("part"))
    if often.limit(1).count():
        # In a part of the order: lesser ids, the first such id by its hashes, ids above it, and so on.
        often = saved(often.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_o", F.ceil(F.col("count") / BLOCK).alias("parts")))).alias("_often")))
        rows = rows.join(small_or_plain(often), keys, "left")
        at = F.coalesce(F.size(F.filter("_often", lambda x: x["_o"] <= F.col("_o"))), F.lit(0))
        own = F.when(at > 0, F.element_at("_often", at))
        part = F.when(own["_o"] == F.col("_o"), F.floor((F.col("_h") / 2.0**64 + 0.5) * own["parts"])).otherwise(F.lit((1 << 63) - 1))
        sub = F.struct(at.alias("at"), part.alias("part"))
    return rows.withColumn("_block", F.struct(*keys, sub.alias("_sub"))).drop("_k1", "_k2", "_often")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text, _next_id, _next: every row and its successor by descending id (nulls last), after the last the first.

    Rows of one id follow one another by the hash of their texts.  Ranges of the order are blocks; the first
    row of each block is also put behind the block before it, so each row finds its successor in its own
    block and the texts are shuffled once.
    """
    rows = renamed(docs, id_col, text_col).select(F.col("_id").cast("long").alias("_id"), F.coalesce("_text", F.lit("")).alias("_text"))
    rows = _placed(rows)
    heads = saved(rows.groupBy("_block").agg(F.max(F.struct("_o", "_h")).alias("_top")).select("_block", "_block._k0", "_top._o", "_top._h"))
    # What stands before a block: the next higher one of its part of the order, else the lowest of the next part that has any.
    ends = saved(heads.groupBy("_k0").agg(F.min("_block").alias("_least")))
    there = sorted(r[0] for r in ends.select("_k0").collect())  # QUANTILES at most
    after = F.create_map(*[F.lit(x) for k, over in zip(there, there[1:] + there[:1], strict=True) for x in (k, over)]) if there else F.create_map().cast("map<int,int>")
    heads = heads.withColumns({"_up": F.lag("_block").over(Window.partitionBy("_k0").orderBy(F.desc("_block"))), "_next": F.element_at(after, F.col("_k0"))})
    heads = heads.join(F.broadcast(ends.withColumnRenamed("_k0", "_next")), "_next")
    heads = small_or_plain(saved(heads.select("_block", "_o", "_h", F.coalesce("_up", "_least").alias("_before"))))
    home = F.struct(F.col("_block").alias("k"), F.lit(0).alias("copy"))
    away = F.struct(F.col("_before").alias("k"), F.lit(1).alias("copy"))
    x = rows.join(heads, ["_block", "_o", "_h"], "left").select("_id", "_text", "_h", F.explode(F.when(F.col("_before").isNull(), F.array(home)).otherwise(F.array(home, away))).alias("_at"))
    order = Window.partitionBy("_at.k").orderBy("_at.copy", F.col("_id").desc_nulls_last(), F.desc("_h"))
    x = x.select("_id", "_text", "_at", F.lead("_text").over(order).alias("_next"), F.lead("_id").over(order).alias("_next_id"))
    return x.filter("_at.copy = 0").drop("_at")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by as many, or all, of the first
    of the next row's text.  An only row is its own successor.  Null text counts as empty.
    """
    x = with_next(docs, id_col, text_col)
    n = F.char_length("_text")
    x = x.withColumn("_n", n).withColumn("_k", F.floor(F.col("_n") / 3).cast("int"))
    x = x.withColumn("_head", F.substring("_text", F.lit(1), F.col("_n") - F.col("_k"))).withColumn("_new", F.substring("_next", F.lit(1), F.col("_k")))
    # Words of the head that the cut does not touch vote for both texts at once.
    x = x.withColumn("_common", F.regexp_extract("_head", r"(?s)^(.*[\x20\x09-\x0D])", 1))
    rest = F.substring("_text", F.char_length("_common") + 1, F.col("_n"))
    new = F.concat(F.substring("_head", F.char_length("_common") + 1, F.col("_n")), "_new")
    x = x.withColumn("_rest", rest).withColumn("_other", new)
    keys = ["_id", "_h", "_next_id", "_next_h", "_n", "_sha"]
    parts = x.select(
        "_id", F.xxhash64("_text").alias("_h"), "_next_id", F.xxhash64("_next").alias("_next_h"), "_n", F.sha2(F.concat("_head", "_new"), 256).alias("_sha"),
        _marked(("_common", True, True), ("_rest", True, False), ("_other", False, True)).alias("_p"),
    )
    sums = _summed(parts, keys, edited=True)
    prints = saved(sums.select(*keys, "_rows", _print("a").alias("fp"), _print("b").alias("efp")))
    after = prints.select(F.col("_id").alias("_i"), F.col("_h").alias("_j"), F.col("fp").alias("_nfp")).distinct()
    out = _counted(prints).join(after, F.col("_next_id").eqNullSafe(F.col("_i")) & (F.col("_next_h") == F.col("_j")))
    return out.select(F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_chars"), F.col("_sha").alias("edited_sha256"), "fp", F.col("efp").alias("edited_fp"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("_nfp")).alias("near_next"))


def _masks(blocks: int, radius: int) -> list[int]:
    """For each table, the bits it keys on: all blocks but as many as the radius."""
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    out = []
    for gone in combinations(range(blocks), radius):
        m = (1 << BITS) - 1
        for b in gone:
            m ^= ((1 << edges[b + 1] - edges[b]) - 1) << edges[b]
        out.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    return out


def _tables(prints: DataFrame, blocks: int, radius: int) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(_masks(blocks, radius))])
    return prints.select("fp", F.explode(keys).alias("_v")).select("fp", "_v.t", "_v.k")


def within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(query, fp): for distinct fingerprints (fp: long) all pairs within the radius but equal ones.

    First tables of radius + 3 blocks.  Keys that over crowd fingerprints share are left out there, and
    all fingerprints under such keys go to tables of 16 blocks, under whose keys 16 ** radius can be.
    """
    both = prints.select("fp").union(queries.select(F.col("query").alias("fp"))).distinct()
    full = _tables(both, radius + 3, radius)
    crowded = saved(full.groupBy("t", "k").count().filter(F.col("count") > crowd).select("t", "k"))
    hot = saved(full.join(crowded, ["t", "k"], "left_semi").select("fp").distinct())

    def pairs(q: DataFrame, x: DataFrame) -> DataFrame:
        near = (F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius) & (F.col("query") != F.col("fp"))
        return q.withColumnRenamed("fp", "query").join(x, ["t", "k"]).filter(near).select("query", "fp")

    asked = queries.select(F.col("query").alias("fp"))
    first = pairs(_tables(asked, radius + 3, radius).join(crowded, ["t", "k"], "left_anti"), _tables(prints, radius + 3, radius))
    # Two fingerprints under one crowded key are both hot.
    finer = pairs(_tables(asked.join(hot, "fp", "left_semi"), 16, radius), _tables(prints.join(hot, "fp", "left_semi"), 16, radius))
    return first.union(finer).distinct()


def has_near(prints: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """fp of those distinct fingerprints that another one lies within the radius of; no pair is made.

    Keys that over crowd fingerprints share are left out of the first tables; all fingerprints under such
    keys go to tables of 16 blocks, under whose keys 16 ** radius can be at most.
    """
    first = _tables(prints, radius + 3, radius)
    crowded = saved(first.groupBy("t", "k").count().filter(F.col("count") > crowd).select("t", "k"))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("_o"))) <= radius) & (F.col("fp") != F.col("_o"))

    def found(x: DataFrame) -> DataFrame:
        y = x.select(F.col("fp").alias("_o"), F.col("t").alias("_t"), F.col("k").alias("_k"))
        return x.join(y, (F.col("t") == F.col("_t")) & (F.col("k") == F.col("_k")) & near, "left_semi").select("fp")

    if crowded.limit(1).count() == 0:
        return found(first).distinct()
    small = small_or_plain(crowded)
    hot = saved(first.join(small, ["t", "k"], "left_semi").select("fp").distinct())
    return found(first.join(small, ["t", "k"], "left_anti")).union(found(_tables(hot, 16, radius))).distinct()
