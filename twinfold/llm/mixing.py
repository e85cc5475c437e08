"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

Documents are dealt by a seeded hash into shards of about ``shard_words`` words of one source, and every shard is cut
into blocks of an equal number of words.  Integer block quotas go from the whole to sources, from a source to groups of
its shards and from a group to its shards, each time by the highest quotients weight / (2 k + 1).  A shard takes every
block ``quota div blocks`` times and, from a seeded block on, ``quota mod blocks`` blocks once more: a run, so nearly all
documents are taken whole or not at all, of a seeded order, so the run is a random share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm._words import one_of_each, row_keys
from twinfold.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # 150 %
MAX_EPOCHS = 2
BLOCK_WORDS = 8
SHARD_WORDS = 32_768
GROUP_SHARDS = 1_024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, *values: Column) -> Column:
    """A hash below 2^32 that DuckDB's md5 gives as well."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(v.cast("string"), F.lit("null")) for v in values])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` of ``sizes(source, source_size)``, one row a source.

    Weights repeat over the sources in code-point order, null last.  Targets share ``share`` of all words by weight and
    stop at ``max_epochs`` times the source; the excess goes to the others until none is above: sources are visited by
    the share at which they stop, and those before the first that keeps its share have stopped.
    """
    everything, order = Window.partitionBy(), Window.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * max_epochs).withColumn("total", F.sum("source_size").over(everything))
    stop = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), F.asc_nulls_last("source"))
    rows = rows.withColumn("capped", F.sum("cap").over(stop.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("open", F.sum("weight").over(stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    num, den = share
    rest = F.col("total") * num - F.coalesce("capped", F.lit(0)) * den  # in 1/den words
    rows = rows.withColumn("rest", rest).withColumn("stops", F.col("cap") * den * F.col("open") <= F.col("rest") * F.col("weight"))
    level = F.max(F.when(~F.col("stops"), F.struct(-F.col("cap").cast("double") / F.col("weight"), F.col("rest").cast("double") / den / F.col("open")))).over(everything).getField("col2")
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return rows.select("source", "source_size", target.alias("target"))


def apportion(parties: DataFrame, parent: list[str], child: str, weight: str, seats: str) -> DataFrame:
    """``parties`` with BIGINT ``quota``: the ``seats`` of each parent dealt to its children by the highest quotients.

    A divisor that surely gives too few seats is applied at once; the few seats that remain go one by one to the highest
    quotients weight / (2 k + 1), ties to the smaller child.  Children with weight zero get none.
    """
    own = Window.partitionBy(*parent)
    live = F.when(F.col(weight) > 0, 1).otherwise(0)
    rows = parties.withColumn("_all", F.sum(F.col(weight).cast("double")).over(own)).withColumn("_n", F.sum(live).over(own))
    per = F.when(F.col("_all") > 0, F.greatest(F.lit(0.0), F.col(seats) - F.col("_n") / 2) / F.col("_all")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_base", F.floor(F.col(weight) * per + F.lit(0.5)).cast("long"))
    rows = rows.withColumn("_base", F.when((F.col(weight) > 0) & (F.col(seats) > F.col("_n") / 2), F.col("_base")).otherwise(F.lit(0)))
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_base").over(own))
    most = F.floor(F.col(weight) / F.col("_all") * (F.col("_left") + F.col("_n"))).cast("long") + 1
    steps = F.when((F.col(weight) > 0) & (F.col("_left") > 0), F.sequence(F.lit(0).cast("long"), most)).otherwise(F.array().cast("array<long>"))
    bids = rows.select(*parent, child, "_left", F.explode(steps).alias("_k"), (F.col(weight).cast("double")).alias("_w"), "_base")
    bids = bids.withColumn("_bid", F.col("_w") / (2 * (F.col("_base") + F.col("_k")) + 1))
    rank = F.row_number().over(own.orderBy(F.desc("_bid"), F.asc_nulls_last(child), "_k"))
    won = bids.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left")).groupBy(*parent, child).agg(F.count("*").alias("_won"))
    keys = [*parent, child]
    won = won.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_won")
    on = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    out = rows.join(won, on, "left").withColumn("quota", F.col("_base") + F.coalesce("_won", F.lit(0)))
    return out.select(*parties.columns, "quota")


def plan_mix(docs: DataFrame, seed: int = 42, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """For every row of ``docs(doc_id, source, size, *)``: where it lies in its shard and how often each block is taken.

    Rows of a shard with one hash, id and size follow each other by ``_k1`` if there is one, so reruns agree.  Adds ``source_size, target, start`` (words of the shard before the row), ``shard_size, blocks, quota, offset``; word w of a shard is in block ``((w + 1) * blocks - 1) div shard_size``.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes).withColumn("shards", F.ceil(F.greatest("source_size", F.lit(1)) / shard_words).cast("long"))
    sources = materialize(sources, "sources")
    every = Window.partitionBy()
    want = F.round(F.sum("target").over(every) / block_words).cast("long")
    by_source = apportion(sources.withColumn("all", F.lit(0)).withColumn("seats", want), ["all"], "source", "target", "seats")
    by_source = materialize(by_source.select("source", "source_size", "target", "shards", F.col("quota").alias("seats")), "quotas")
    named = by_source.select(F.col("source").alias("_source"), "source_size", "target", "shards")
    placed = docs.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = seeded(seed, F.col("doc_id"), F.col("size"))
    placed = placed.withColumn("_order", order).withColumn("_shard", F.floor(F.col("_order") * F.col("shards") / F.lit(2**32)).cast("long"))
    shard = Window.partitionBy("source", "_shard")
    within = ["_order", F.asc_nulls_first("doc_id"), "size", *[c for c in ("_k1", "_k2") if c in docs.columns]]
    placed = placed.withColumn("_upto", F.sum("size").over(shard.orderBy(*within).rowsBetween(Window.unboundedPreceding, 0)))
    placed = materialize(placed.withColumn("start", F.col("_upto") - F.col("size")), "placed")
    shards = placed.groupBy("source", "_shard").agg(F.sum("size").alias("shard_size")).withColumn("_group", F.floor(F.col("_shard") / GROUP_SHARDS).cast("long"))
    groups = shards.groupBy("source", "_group").agg(F.sum("shard_size").alias("group_size"))
    seats = by_source.select(F.col("source").alias("_source"), "seats")
    groups = groups.join(seats, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    groups = apportion(groups, ["source"], "_group", "group_size", "seats").select(F.col("source").alias("_s"), F.col("_group").alias("_g"), F.col("quota").alias("seats"))
    shards = shards.join(groups, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_group") == F.col("_g"))).drop("_s", "_g")
    shards = apportion(shards, ["source", "_group"], "_shard", "shard_size", "seats")
    blocks = F.greatest(F.lit(1), F.round(F.col("shard_size") / block_words)).cast("long")
    shards = shards.withColumn("blocks", blocks).withColumn("quota", F.least("quota", F.col("blocks") * MAX_EPOCHS))
    shards = shards.withColumn("offset", seeded(seed, F.col("source"), F.col("_shard")) % F.col("blocks"))
    shards = shards.select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), "shard_size", "blocks", "quota", "offset")
    out = placed.join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")))
    return out.drop("_s", "_h", "_order", "_upto", "_shard", "shards")


def _block_of(word: Column) -> Column:
    """The block that holds the word at this place of the shard."""
    return F.floor(((word + 1) * F.col("blocks") - 1) / F.col("shard_size")).cast("long")


def _times(block: Column) -> Column:
    """How often a block is taken."""
    more = F.pmod(block + F.col("offset"), F.col("blocks")) < F.col("quota") % F.col("blocks")
    return F.floor(F.col("quota") / F.col("blocks")).cast("long") + more.cast("long")


def _edge(block: Column) -> Column:
    """First word of a block: the smallest w with (w + 1) * blocks - 1 >= block * shard_size."""
    return F.ceil((block * F.col("shard_size") + 1) / F.col("blocks")).cast("long") - 1


def with_taken(planned: DataFrame) -> DataFrame:
    """``planned`` with ``taken``: words of each row that the mix takes, repeats counted."""
    start, end = F.col("start"), F.col("start") + F.col("size")
    blocks = F.sequence(_block_of(start), _block_of(end - 1))
    part = lambda b: (F.least(end, _edge(b + 1)) - F.greatest(start, _edge(b))) * _times(b)
    taken = F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + part(b))
    return planned.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long"))


def mix_sizes(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs(doc_id, source, text)``.

    Null texts have size zero and null sources are one source, last in order; rows that repeat an id or are equal are
    dealt like any others; an empty table gives no rows.  A source without words has target zero.
    """
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sized")
    return with_taken(plan_mix(sized, seed)).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mixed documents with the columns of ``docs``: a whole copy for each full pass, and the words of the blocks
    taken once more (with the blanks that follow them) as one more row.  ``n_chars`` is set anew where there is one.

    Null texts and texts without a word have nothing to take and vanish; rows with null ids or sources and rows that
    repeat are dealt like any others, equal rows are fetched once; texts of any length are cut at their words; columns
    may have any name; an empty table gives no rows.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # no name of docs can clash with the new columns
    own = {c: F.col(f"c{k}") for k, c in enumerate(docs.columns)}
    k1, k2 = row_keys(plain.columns)
    narrow = plain.select(own["doc_id"].cast("long").alias("doc_id"), own["source"].cast("string").alias("source"), word_count(own["text"]).alias("size"), k1.alias("_k1"), k2.alias("_k2"))
    planned = with_taken(plan_mix(materialize(narrow, "sized"), seed)).where("taken > 0")
    planned = planned.select("_k1", "_k2", "start", "size", "shard_size", "blocks", "quota", "offset")
    # equal rows lie side by side in a shard and take what any of them may: their text is joined to each of their places
    texts = one_of_each(plain.withColumn("_k1", k1).withColumn("_k2", k2), ("_k1", "_k2"))
    rows = planned.join(texts, ["_k1", "_k2"])
    words = F.regexp_extract_all(own["text"], F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    full = F.floor(F.col("quota") / F.col("blocks")).cast("int")
    once = F.array_join(F.filter(words, lambda w, i: _times(_block_of(F.col("start") + i)) > full), "")
    copies = F.concat(F.array_repeat(own["text"], full), F.when(F.col("quota") % F.col("blocks") > 0, F.array(once)).otherwise(F.array().cast("array<string>")))
    out = rows.withColumn("_text", F.explode(copies)).where("_text <> ''")
    value = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return out.select(*[value.get(c, own[c]).cast(t).alias(f"c{k}") for k, (c, t) in enumerate(docs.dtypes)]).toDF(*docs.columns)


def _apportion_sql(name: str, rows: str, parent: str, child: str, weight: str, seats: str) -> str:
    """The steps of ``apportion`` as CTEs; the last is ``name``, with all columns of ``rows`` and ``quota``."""
    return f"""
{name}_a AS (SELECT *, sum({weight}::DOUBLE) OVER p AS w_all, count(*) FILTER (WHERE {weight} > 0) OVER p AS w_n FROM {rows} WINDOW p AS (PARTITION BY {parent})),
{name}_b AS (SELECT *, CASE WHEN {weight} > 0 AND {seats} > w_n / 2 THEN floor({weight} * (({seats} - w_n / 2) / w_all) + 0.5)::BIGINT ELSE 0 END AS base FROM {name}_a),
{name}_c AS (SELECT *, {seats} - sum(base) OVER (PARTITION BY {parent}) AS w_left FROM {name}_b),
{name}_d AS (SELECT {parent}, {child}, w_left, {weight}::DOUBLE AS w, base, unnest(range(0, floor({weight} / w_all * (w_left + w_n))::BIGINT + 2)) AS k FROM {name}_c WHERE {weight} > 0 AND w_left > 0),
{name}_e AS (SELECT *, row_number() OVER (PARTITION BY {parent} ORDER BY w / (2 * (base + k) + 1) DESC, {child} ASC NULLS LAST, k) AS r FROM {name}_d),
{name}_f AS (SELECT {parent}, {child}, count(*) AS won FROM {name}_e WHERE r <= w_left GROUP BY ALL),
{name} AS (SELECT c.*, c.base + coalesce(f.won, 0) AS quota FROM {name}_c c LEFT JOIN {name}_f f ON {" AND ".join(f"c.{x} IS NOT DISTINCT FROM f.{x}" for x in [*parent.split(", "), child])}),"""


def _seeded_sql(seed: int, *values: str) -> str:
    return f"""('0x' || substr(md5(concat_ws('|', '{seed}', {", ".join(f"coalesce(({v})::VARCHAR, 'null')" for v in values)})), 1, 8))::BIGINT"""


ORACLE = f"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
turned AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2 AS cap, sum(source_size) OVER ()::BIGINT AS total FROM sizes),
swept AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped, (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open FROM turned WINDOW o AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST)),
stopped AS (SELECT *, total * 3 - capped * 2 AS rest, cap * 2 * open <= (total * 3 - capped * 2) * weight AS stops FROM swept),
level AS (SELECT arg_min(rest::DOUBLE / 2 / open, cap::DOUBLE / weight) AS level FROM stopped WHERE NOT stops),
targets AS (SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE weight * level END AS target, ceil(greatest(source_size, 1) / {SHARD_WORDS})::BIGINT AS shards, 0 AS a FROM stopped CROSS JOIN level),
seated AS (SELECT *, round(sum(target) OVER () / {BLOCK_WORDS})::BIGINT AS seats FROM targets),
{_apportion_sql("bysource", "seated", "a", "source", "target", "seats")}
dealt AS (SELECT d.*, b.source_size, b.target, {_seeded_sql(42, "d.doc_id", "d.size")} AS ord, b.shards FROM docs d JOIN bysource b ON d.source IS NOT DISTINCT FROM b.source),
sharded AS (SELECT *, floor(ord * shards / 4294967296)::BIGINT AS shard FROM dealt),
placed AS (SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY ord, doc_id ASC NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS begins FROM sharded),
shardsize AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, (shard // {GROUP_SHARDS})::BIGINT AS grp FROM placed GROUP BY source, shard),
grouped AS (SELECT s.source, s.grp, sum(s.shard_size)::BIGINT AS group_size, any_value(b.quota) AS seats FROM shardsize s JOIN bysource b ON s.source IS NOT DISTINCT FROM b.source GROUP BY ALL),
{_apportion_sql("bygroup", "grouped", "source", "grp", "group_size", "seats")}
ofgroup AS (SELECT s.*, g.quota AS seats FROM shardsize s JOIN bygroup g ON s.source IS NOT DISTINCT FROM g.source AND s.grp = g.grp),
{_apportion_sql("byshard", "ofgroup", "source, grp", "shard", "shard_size", "seats")}
blocked AS (SELECT source, shard, shard_size, greatest(1, round(shard_size / {BLOCK_WORDS}))::BIGINT AS blocks, quota FROM byshard),
walks AS (SELECT *, least(quota, blocks * {MAX_EPOCHS})::BIGINT AS q, {_seeded_sql(42, "source", "shard")} % blocks AS off FROM blocked),
ranged AS (SELECT row_number() OVER () AS r, p.doc_id, p.size, p.source_size, p.target, p.begins, w.* EXCLUDE (source, shard) FROM placed p JOIN walks w ON p.source IS NOT DISTINCT FROM w.source AND p.shard = w.shard),
pieces AS (SELECT *, unnest(range(((begins + 1) * blocks - 1) // shard_size, ((begins + size) * blocks - 1) // shard_size + 1)) AS b FROM ranged WHERE size > 0),
counted AS (SELECT r, sum((least(begins + size, ceil(((b + 1) * shard_size + 1) / blocks)::BIGINT - 1) - greatest(begins, ceil((b * shard_size + 1) / blocks)::BIGINT - 1)) * (q // blocks + ((b + off) % blocks < q % blocks)::BIGINT))::BIGINT AS taken FROM pieces GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM ranged LEFT JOIN counted USING (r)
"""
