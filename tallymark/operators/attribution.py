"""Attribution of log events to the spans (executions) they belong to.

A span is ``(span_id, name, start, end)``, an event ``(event_id, ts, name, message)`` with a
unique ``event_id``; further columns may carry other ids. Where several spans claim an event,
the earliest wins: spans without a start first, then by ``(start, span_id)``. So each kind of
match only has to deliver its earliest span per event, and no step emits all span/event pairs:

* equal name or id: the earliest span per value, one row per value, then an equi join;
* time window: windows are cut into disjoint intervals that already name their winner;
* name inside a message: an index of rare substrings, behind a bit table that drops the others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.functions.timeline import MICROS, micros, shift_seconds
from tallymark.operators.keys import col
from tallymark.session import broadcast_if_small, durable

SPAN_BUFFER_SECONDS = 30
PROXIMITY_SECONDS = 10
MISSING_BOUND_SECONDS = 600
# Fixed value: the start of a span that nothing is known about.
OPEN_START = "2000-01-01 00:00:00"

# The longest substring a name is filed under; a power of two.
_GRAM = 16
# Bits of the table of filed substrings: per name, and the bounds of its size as powers of two (1 MB at most).
_BITS_PER_PATTERN = 16
_MIN_TABLE, _MAX_TABLE = 12, 23
_BEFORE = (Window.unboundedPreceding, -1)


def span_rank(start: Column, span_id: Column, known_start: Column | None = None) -> Column:
    """The order in which spans claim events; the smallest rank wins."""
    known = start.isNotNull() if known_start is None else known_start
    return F.struct(known.alias("known_start"), start.alias("start"), span_id.alias("span_id"))


def _ranked(spans: DataFrame) -> DataFrame:
    """Spans with their ``rank``, written once because every kind of match reads them again."""
    known = F.col("known_start") if "known_start" in spans.columns else None
    return durable(spans.withColumn("rank", span_rank(F.col("start"), F.col("span_id"), known)))


# --- matches by equal value -------------------------------------------------------------


def with_value_match(
    events: DataFrame, ranked: DataFrame, event_column: str, span_column: str, out: str
) -> DataFrame:
    """Add ``out``: the rank of the earliest span whose ``span_column`` equals the event's value."""
    lookup = (
        ranked.filter(col(span_column).isNotNull())
        .groupBy(col(span_column).alias("_value"))
        .agg(F.min("rank").alias(out))
    )
    found = events.join(broadcast_if_small(lookup), col(event_column) == F.col("_value"), "left_outer")
    return found.drop("_value")


# --- matches by time --------------------------------------------------------------------


def disjoint_windows(windows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cut ``(lo, hi, rank)`` windows so that each moment keeps only its earliest window.

    Bounds are microseconds, both inclusive; windows go by ``(lo, rank)``, separately per value
    of ``by``. The windows before one that reach into it cover it from its start on, so it keeps
    what lies after the furthest end before it: one running maximum decides everything. The
    maximum is taken inside the range partitions of the sorted windows and carried from one
    partition to the next by one row per partition (and ``by`` value). The sorted windows are
    checkpointed first, so both uses see the same partitions.
    """
    by_cols = [col(b) for b in by]
    # Of equal windows only the earliest span can win.
    distinct = windows.filter("lo <= hi").groupBy(*by_cols, "lo", "hi").agg(F.min("rank").alias("rank"))
    placed = durable(
        distinct.repartitionByRange(*by_cols, "lo", "rank", "hi").withColumn("_part", F.spark_partition_id())
    )
    ends = placed.groupBy(*[col(b).alias(f"_c_{b}") for b in by], F.col("_part").alias("_c_part")).agg(
        F.max("hi").alias("_end")
    )
    # Without ``by`` this window sees one row per shuffle partition, and no more.
    across = Window.partitionBy(*[f"_c_{b}" for b in by]).orderBy("_c_part").rowsBetween(*_BEFORE)
    carried = ends.withColumn("_carry", F.max("_end").over(across)).drop("_end")
    inside = Window.partitionBy("_part", *by_cols).orderBy("lo", "rank", "hi").rowsBetween(*_BEFORE)
    same = F.col("_part") == F.col("_c_part")
    for b in by:
        same = same & (col(b) == col(f"_c_{b}"))
    reached = placed.withColumn("_inside", F.max("hi").over(inside)).join(carried, same)
    start = F.greatest("lo", F.greatest("_inside", "_carry") + 1)
    return reached.select(*by_cols, start.alias("lo"), "hi", "rank").filter("lo <= hi")


def time_range(events: DataFrame) -> tuple[int, int] | None:
    """First and last event time in microseconds; ``None`` without any."""
    at = micros(F.col("ts"))
    row = events.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    return None if row["lo"] is None else (row["lo"], row["hi"])


def earliest_window(
    events: DataFrame,
    windows: DataFrame,
    out: str,
    within: tuple[int, int] | None,
    by: tuple[str, str] | None = None,
) -> DataFrame:
    """Add ``out``: the ``rank`` of the earliest window that holds the event's time, else null.

    ``within`` is the :func:`time_range` of the events. ``by`` = (event column, window column)
    restricts an event to windows of its own value. Windows come in two layers: those with
    ``first`` win over the others whatever their time. Inside a layer ranks must go by ``lo``.

    Event times and the starts of the disjoint intervals are sorted together, by range partitions that Spark cuts
    by their number, whatever their times; the last start before an event decides, and each partition takes over the
    last start of those before it. Only event ids travel, and a burst of events in one moment is split by them.
    """
    empty = events.withColumn(out, F.lit(None).cast(windows.schema["rank"].dataType))
    if within is None:
        return empty
    inside = windows.filter((F.col("hi") >= within[0]) & (F.col("lo") <= within[1])).select(
        *([col(by[1]).alias("_by")] if by else []), "lo", "hi", "rank", "first")
    group = ["_by"] if by else []
    intervals = disjoint_windows(inside, ["first", *group])
    held = F.struct("hi", "rank")
    starts = intervals.select(
        *group, F.col("lo").alias("_at"), F.lit(False).alias("_is_event"), F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"),
        F.when(F.col("first"), held).alias("_first"), F.when(~F.col("first"), held).alias("_other"))
    points = events.select(
        *([col(by[0]).alias("_by")] if by else []), micros(F.col("ts")).alias("_at"), F.lit(True).alias("_is_event"), "event_id")
    both = points.filter(" AND ".join(f"{c} IS NOT NULL" for c in ["_at", *group])).unionByName(starts, allowMissingColumns=True)
    order = [*group, "_at", "_is_event", "event_id"]
    placed = durable(both.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    layers = ("_first", "_other")
    # A row per partition (and value), however many events.
    ends = placed.groupBy(*[F.col(c).alias(f"_c{c}") for c in group], F.col("_part").alias("_c_part")).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_c{c}") for c in layers])
    across = Window.partitionBy(*[f"_c{c}" for c in group]).orderBy("_c_part").rowsBetween(*_BEFORE)
    carried = ends.select(
        *[F.col(f"_c{c}") for c in group], "_c_part", *[F.last(f"_c{c}", ignorenulls=True).over(across).alias(f"_carried{c}") for c in layers])
    in_time = Window.partitionBy("_part", *group).orderBy("_at", "_is_event").rowsBetween(Window.unboundedPreceding, 0)
    swept = placed.select(
        *group, "_part", "_at", "_is_event", "event_id", *[F.last(c, ignorenulls=True).over(in_time).alias(c) for c in layers]).filter("_is_event")
    same = F.col("_part") == F.col("_c_part")
    for c in group:
        same = same & (F.col(c) == F.col(f"_c{c}"))
    known = swept.join(carried, same).select(
        F.col("event_id").alias("_swept_id"), "_at", *[F.coalesce(c, f"_carried{c}").alias(c) for c in layers])
    won = F.coalesce(*[F.when(F.col("_at") <= F.col(f"{c}.hi"), F.col(f"{c}.rank")) for c in layers])
    winners = known.select("_swept_id", won.alias(out)).filter(F.col(out).isNotNull())
    return events.join(winners, F.col("event_id") == F.col("_swept_id"), "left_outer").drop("_swept_id")


def span_windows(ranked: DataFrame, buffer_seconds: float) -> DataFrame:
    """``(lo, hi, rank)`` of spans with both bounds, widened by the buffer; other columns stay."""
    pad = int(buffer_seconds * MICROS)
    bounded = ranked.filter("start IS NOT NULL AND `end` IS NOT NULL")
    return bounded.withColumns(
        {"lo": micros(F.col("start")) - pad, "hi": micros(F.col("end")) + pad}
    )


def with_window_match(
    events: DataFrame,
    ranked: DataFrame,
    buffer_seconds: float,
    out: str,
    within: tuple[int, int] | None,
    by: tuple[str, str] | None = None,
) -> DataFrame:
    """Add ``out``: the rank of the earliest span around the event's time.

    Spans without a known start come first whatever their window; inside each of the two layers
    ranks go by start.
    """
    windows = span_windows(ranked, buffer_seconds).withColumn("first", ~F.col("rank.known_start"))
    return earliest_window(events, windows, out, within, by)


# --- matches by name inside the message -------------------------------------------------


def pattern_hits(events: DataFrame, patterns: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns of events beside the row of ``patterns``, for every ``low`` that is inside the lower-cased message.

    ``patterns`` has one row per distinct ``low`` (lower case, not empty); its other columns come along. Each pattern is filed
    under one substring as long as the largest power of two that fits into it (16 at most): the one that fewest patterns
    have. A message yields its substrings of these lengths, and a bit table over the filed ones, of bounded size, drops those
    under which nothing is filed right where they arise; only what is left meets the patterns, and every hit is checked in full.
    """
    spark = events.sparkSession
    sized = patterns.withColumn("_size", F.least(F.pow(F.lit(2), F.floor(F.log2(F.length("low")))), F.lit(_GRAM)).cast("int"))
    pieces = sized.select("low", F.explode(F.array_distinct(_grams(F.col("low"), F.col("_size")))).alias("_gram"))
    users = pieces.groupBy(F.col("_gram").alias("_used_gram")).agg(F.count("*").alias("_users"))
    places = (
        pieces.join(users, F.col("_gram") == F.col("_used_gram"))
        .groupBy(F.col("low").alias("_low"))
        .agg(F.min_by("_gram", F.struct("_users", "_gram")).alias("_filed_gram"))
    )
    # Filed once: its size, the bit table and the join must see the same patterns.
    filed = durable(patterns.join(places, F.col("low") == F.col("_low")).drop("_low"))
    # At most five lengths: the powers of two up to the longest.
    count, sizes = filed.agg(F.count("*"), F.array_sort(F.collect_set(F.length("_filed_gram")))).first()
    text = F.lower("message").alias("_text")
    looked = events.filter("message IS NOT NULL").select(*[col(c) for c in keep], text)
    bits = 1 << min(max((_BITS_PER_PATTERN * count).bit_length(), _MIN_TABLE), _MAX_TABLE)
    table = _bit_table(spark, filed.select(F.xxhash64("_filed_gram").alias("hash")), bits).scalar()
    found = [_grams(F.col("_text"), F.lit(n)) for n in sizes] or [F.array().cast("array<string>")]
    place = F.pmod(F.xxhash64("_gram"), F.lit(bits))
    listed = F.getbit(F.get(table, F.shiftright(place, 6).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1
    possible = looked.withColumn("_gram", F.explode(F.array_distinct(F.concat(*found)))).filter(listed)
    hits = possible.join(
        broadcast_if_small(filed), (F.col("_gram") == F.col("_filed_gram")) & F.contains(F.col("_text"), F.col("low"))
    )
    return hits.drop("_text", "_gram", "_filed_gram")


def _grams(text: Column, size: Column) -> Column:
    """All substrings of ``size`` characters; the lookahead matches at every position, so this is one linear scan."""
    return F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))")), F.lit(1))


def _bit_table(spark: SparkSession, hashes: DataFrame, bits: int) -> DataFrame:
    """One row: an array of ``bits / 64`` longs in which the bit of every ``hash`` is set."""
    place = F.pmod("hash", F.lit(bits))
    word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, cast(pmod(hash, {bits}) % 64 AS int))")
    words = hashes.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    every = spark.range(bits // 64).join(words, F.col("id") == F.col("word"), "left_outer")
    in_order = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bit", F.lit(0).cast("long")).alias("bit"))))
    return every.agg(F.transform(in_order, lambda w: w["bit"]).alias("table"))


def _patterns(names: DataFrame, *values: Column) -> DataFrame:
    """One row per lower-cased ``name``, with aggregates over its spellings."""
    low = F.lower("name").alias("low")
    named = names.filter("name <> ''")
    return named.groupBy(low).agg(*values) if values else named.select(low).distinct()


def names_in_messages(events: DataFrame, names: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns of events and ``name``, for every name inside the message, whatever its case."""
    spellings = names.select("name").filter("name <> ''").distinct().withColumn("_spelt", F.lower("name"))
    hits = pattern_hits(events, _patterns(names), keep)
    return hits.join(broadcast_if_small(spellings), F.col("low") == F.col("_spelt")).select(*[col(c) for c in keep], "name")


def mention_times(events: DataFrame, names: DataFrame) -> DataFrame:
    """``low, first, last``: the first and last message that holds the lower-cased name; names in no message are left out.

    Each task reduces its hits to one row per name before anything is shuffled.
    """
    hits = pattern_hits(events, _patterns(names), ["ts"])
    return hits.groupBy("low").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


def with_message_match(events: DataFrame, ranked: DataFrame, out: str) -> DataFrame:
    """Add ``out``: the rank of the earliest span whose name occurs in the event's message.

    Names are filed with their least rank, and each task reduces its hits to one row per event.
    """
    hits = pattern_hits(events, _patterns(ranked, F.min("rank").alias("_rank")), ["event_id"])
    per_event = hits.groupBy(F.col("event_id").alias("_hit_id")).agg(F.min("_rank").alias(out))
    return events.join(per_event, F.col("event_id") == F.col("_hit_id"), "left_outer").drop("_hit_id")


# --- operators --------------------------------------------------------------------------


def repair_bounds(spans: DataFrame, events: DataFrame) -> DataFrame:
    """Fill missing span bounds and add ``known_start``.

    A missing start is the first event with the span's name (as its own name or in its message),
    else ten minutes before the end, else open. A missing end is the last such event, else ten
    minutes after the start. Only the names of spans without a bound are looked for.
    """
    incomplete = spans.filter("start IS NULL OR `end` IS NULL").select("name").filter("name IS NOT NULL").distinct()
    wanted = durable(incomplete.withColumnRenamed("name", "_n").withColumn("_n_low", F.lower("_n")))
    own = (
        events.select("name", "ts")
        .join(broadcast_if_small(wanted.select("_n")), F.col("name") == F.col("_n"), "left_semi")
        .groupBy("name")
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    )
    told = mention_times(events, wanted.select(F.col("_n").alias("name")))
    told = told.join(wanted, F.col("low") == F.col("_n_low")).select(F.col("_n").alias("name"), "first", "last")
    seen = (
        own.unionByName(told)
        .groupBy(F.col("name").alias("_seen_name"))
        .agg(F.min("first").alias("_first"), F.max("last").alias("_last"))
    )
    joined = spans.join(seen, F.col("name") == F.col("_seen_name"), "left_outer")
    ts_type = events.schema["ts"].dataType
    start = F.coalesce(
        F.col("start"), F.col("_first"), shift_seconds(F.col("end"), -MISSING_BOUND_SECONDS), F.lit(OPEN_START).cast(ts_type)
    )
    filled = joined.withColumn("known_start", F.col("start").isNotNull()).withColumn("start", start)
    end = F.coalesce(F.col("end"), F.col("_last"), shift_seconds(F.col("start"), MISSING_BOUND_SECONDS))
    return filled.withColumn("end", end).drop("_seen_name", "_first", "_last")


def _kept(assigned: str | None, found: Column) -> Column:
    """The span an event already has, where ``assigned`` names a column of such ids, else ``found``."""
    return F.coalesce(col(assigned), found) if assigned else found


def _kind(assigned: str | None, kind: Column) -> Column:
    return F.when(col(assigned).isNotNull(), "assigned").otherwise(kind) if assigned else kind


def attribute_by_window(
    events: DataFrame,
    spans: DataFrame,
    buffer_seconds: float = SPAN_BUFFER_SECONDS,
    id_columns: Mapping[str, str] | None = None,
    assigned: str | None = None,
) -> DataFrame:
    """Add ``span_id``: the earliest span around the event, or with one of its ids.

    ``assigned`` names a column with span ids that events have already; those stay.

    An event that carries a name only belongs to spans of that name; ``id_columns`` maps event
    columns to span columns that must be equal for an id match. Spans need both bounds.
    """
    ranked, within = _ranked(spans), time_range(events)
    found = with_window_match(events, ranked, buffer_seconds, "_any", within)
    named = ranked.filter("name IS NOT NULL")
    found = with_window_match(found, named, buffer_seconds, "_named", within, ("name", "name"))
    ranks = [F.when(F.col("name").isNull(), F.col("_any")).otherwise(F.col("_named"))]
    for i, (event_column, span_column) in enumerate((id_columns or {}).items()):
        found = with_value_match(found, ranked, event_column, span_column, f"_id{i}")
        ranks.append(F.col(f"_id{i}"))
    winner = F.least(*ranks) if len(ranks) > 1 else ranks[0]
    return found.select(*[col(c) for c in events.columns], _kept(assigned, winner["span_id"]).alias("span_id"))


def attribute_cascade(
    events: DataFrame,
    spans: DataFrame,
    default_id: str = "default",
    buffer_seconds: float = SPAN_BUFFER_SECONDS,
    assigned: str | None = None,
) -> DataFrame:
    """Add ``span_id`` and ``match_kind`` (``name``, ``time``, ``message`` or ``default``).

    Events that have a span id in the ``assigned`` column keep it, with kind ``assigned``.

    Missing span bounds are repaired first. The earliest span that matches in any of the three
    ways takes the event; ``match_kind`` is the first way, in that order, in which it matches.
    """
    spans = durable(spans)
    ranked = _ranked(repair_bounds(spans, events))
    found = with_value_match(events, ranked, "name", "name", "_name")
    found = with_window_match(found, ranked, buffer_seconds, "_time", time_range(events))
    found = with_message_match(found, ranked, "_message")
    winner = F.least("_name", "_time", "_message")
    kind = (
        F.when(winner.isNull(), "default")
        .when(winner == F.col("_name"), "name")
        .when(winner == F.col("_time"), "time")
        .otherwise("message")
    )
    return found.select(
        *[col(c) for c in events.columns],
        F.coalesce(_kept(assigned, winner["span_id"]).cast("string"), F.lit(default_id)).alias("span_id"),
        _kind(assigned, kind).alias("match_kind"),
    )


def attribute_by_ids(
    events: DataFrame,
    spans: DataFrame,
    id_columns: Mapping[str, str],
    proximity_seconds: float = PROXIMITY_SECONDS,
    fallback_prefix: str = "fallback",
    assigned: str | None = None,
) -> DataFrame:
    """Add ``span_id`` and ``match_kind`` (``id``, ``proximity`` or ``minute``).

    Events that have a span id in the ``assigned`` column keep it, with kind ``assigned``, and
    their times count for the range of that span.

    Events with an equal id go to the earliest such span. The events of a span so found, widened
    by the proximity, then claim the remaining ones; of several, the range that starts first. All
    ranges come from the id matches, none from other proximity matches. What is left is labelled
    by its minute.
    """
    ranked = _ranked(spans)
    found = events
    for i, (event_column, span_column) in enumerate(id_columns.items()):
        found = with_value_match(found, ranked, event_column, span_column, f"_id{i}")
    ids = [F.col(f"_id{i}") for i in range(len(id_columns))]
    winner = F.least(*ids) if len(ids) > 1 else ids[0]
    found = found.select(*[col(c) for c in events.columns], _kept(assigned, winner["span_id"]).alias("_span"))
    pad = int(proximity_seconds * MICROS)
    ranges = (
        found.filter("_span IS NOT NULL")
        .groupBy("_span")
        .agg((F.min(micros(F.col("ts"))) - pad).alias("lo"), (F.max(micros(F.col("ts"))) + pad).alias("hi"))
        .select("lo", "hi", F.struct("lo", F.col("_span").alias("span_id")).alias("rank"), F.lit(False).alias("first"))
    )
    near = earliest_window(found, ranges, "_near", time_range(events))
    minute = F.concat(F.lit(f"{fallback_prefix}-"), F.date_format("ts", "yyyy-MM-dd HH:mm"))
    kind = F.when(F.col("_span").isNotNull(), "id").when(F.col("_near").isNotNull(), "proximity").otherwise("minute")
    return near.select(
        *[col(c) for c in events.columns],
        F.coalesce(F.col("_span").cast("string"), F.col("_near.span_id").cast("string"), minute).alias("span_id"),
        _kind(assigned, kind).alias("match_kind"),
    )


def missing_parents(children: DataFrame, parents: DataFrame, key: Mapping[str, str]) -> DataFrame:
    """Rows of ``children`` whose reference (``{child column: parent column}``) has no parent."""
    known = parents.select(*[col(p).alias(f"_p{i}") for i, p in enumerate(key.values())]).distinct()
    match = [col(c) == F.col(f"_p{i}") for i, c in enumerate(key)]
    return children.join(known, match, "left_anti")
