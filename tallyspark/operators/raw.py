"""Parsing of stored raw messages, and catalogues of the files that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_ticks(messages: DataFrame, text: str) -> DataFrame:
    """Trade messages of JSON lines as ticks; the event time defaults to the trade time. Other kinds and broken lines give no rows."""
    field = lambda name, kind="string": F.get_json_object(text, f"$.{name}").try_cast(kind)  # noqa: E731  names differ by case alone
    return messages.where(field("e") == "trade").select(
        *[c for c in messages.columns if c != text], field("T", "long").alias("exchange_ms"), F.coalesce(field("E", "long"), field("T", "long")).alias("event_ms"), field("p", "double").alias("price"),
        field("q", "double").alias("size"), field("t", "long").alias("trade_id"), field("m", "boolean").alias("buyer_is_maker"), field("s").alias("symbol"),
    )


def explode_frames(frames: DataFrame, text: str, received: str, change: str) -> DataFrame:
    """Rows of book frames: a frame is one event or an array of events, an event's price_changes are rows of their own.

    frame_id: sha256 of received|market|timestamp; child: the place in price_changes, null for an event without.
    """
    events = F.from_json(text, f"array<struct<event_type: string, market: string, timestamp: string, price_changes: array<{change}>>>")
    e = frames.select(received, F.explode(events).alias("e")).select(received, "e.*")
    frame_id = F.sha2(F.concat_ws("|", F.col(received).cast("string"), "market", "timestamp"), 256)
    return e.select(received, "event_type", "market", F.col("timestamp").try_cast("long").alias("timestamp_ms"), frame_id.alias("frame_id"), F.posexplode_outer("price_changes").alias("child", "change"))


def parse_levels(levels: Column) -> Column:
    """array<struct<price: double, size: double>> of levels given as text; levels that are no numbers are left out."""
    parsed = F.transform(levels, lambda x: F.struct(x["price"].try_cast("double").alias("price"), x["size"].try_cast("double").alias("size")))
    return F.filter(parsed, lambda x: x["price"].isNotNull() & x["size"].isNotNull())


def valid_book_rows(rows: DataFrame, version: str) -> DataFrame:
    """Rows of one collector version that are valid and have bid, ask and mid."""
    return rows.where((F.col("collector_version") == version) & F.col("book_state_valid") & (F.col("book_state_status") == "VALID") & F.col("mid").isNotNull() & F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull())


def version_counts(rows: DataFrame, version: str) -> DataFrame:
    """kept, excluded: rows of one collector version and the others."""
    own = F.coalesce(F.col("collector_version") == version, F.lit(False))
    return rows.agg(F.count_if(own).alias("kept"), F.count_if(~own).alias("excluded"))


def rotation_code(discovered: Column, subscribed: Column, tokens: Column, snapshots: Column, gap_ms: Column, most_gap_ms: int) -> Column:
    """The first rule that a rotation between markets fails; null if it passes."""
    return (
        F.when(~F.coalesce(discovered, F.lit(False)), "DISCOVERY").when(~F.coalesce(subscribed, F.lit(False)), "SUBSCRIPTION").when(F.coalesce(tokens, F.lit(0)) < 2, "DUAL_TOKEN")
        .when(F.coalesce(snapshots, F.lit(0)) < 2, "SNAPSHOT").when(gap_ms.isNull() | (gap_ms > most_gap_ms), "GAP")
    )


def market_metadata(bodies: DataFrame, body: str, prefix: str, seconds: int) -> DataFrame:
    """Condition, slug, window and tokens of stored metadata bodies.

    The start that the slug names comes before startDate; endDate falls back to start + seconds. Tokens
    are the field tokens, else clobTokenIds zipped with outcomes.
    """
    from tallyspark.functions.scalars import parse_ms, slug_window

    m = bodies.select(F.from_json(body, "conditionId string, slug string, startDate string, endDate string, tokens array<struct<outcome: string, token_id: string>>, clobTokenIds array<string>, outcomes array<string>").alias("m")).select("m.*")
    start = F.coalesce(slug_window(F.col("slug"), prefix, seconds)[0], parse_ms(F.col("startDate")))
    zipped = F.zip_with("outcomes", "clobTokenIds", lambda o, t: F.struct(o.alias("outcome"), t.alias("token_id")))
    return m.select(F.col("conditionId").alias("condition_id"), "slug", start.alias("market_start_ms"), F.coalesce(parse_ms(F.col("endDate")), start + seconds * 1000).alias("market_end_ms"), F.coalesce("tokens", zipped).alias("tokens"))


def closed_files(sidecars: DataFrame) -> DataFrame:
    """The catalogue of closed files that can be used: integrity OK, no parse errors, bounds, session and hash known."""
    good = (F.col("integrity_status") == "OK") & (F.coalesce("parse_errors", F.lit(0)) == 0)
    known = [F.col(c).isNotNull() for c in ("first_timestamp_ms", "last_timestamp_ms", "session_id", "sha256")]
    for k in known:
        good = good & k
    return sidecars.where(good).select("file", "session_id", "first_timestamp_ms", "last_timestamp_ms", "record_count", "sha256")


def files_for_windows(files: DataFrame, windows: DataFrame, window_id: str, predecessor: bool = True) -> DataFrame:
    """window_id, file, role: the files of a window's session that meet [start_ms, end_ms], and the latest one that ends before it.

    windows: window_id, session_id, start_ms, end_ms. A session's files are few; they are joined on the session.
    """
    met = windows.join(files, "session_id").where(F.col("first_timestamp_ms") <= F.col("end_ms"))
    inside = met.where(F.col("last_timestamp_ms") >= F.col("start_ms")).select(window_id, "file", F.lit("OVERLAP").alias("role"))
    if not predecessor:
        return inside
    earlier = met.where(F.col("last_timestamp_ms") < F.col("start_ms")).groupBy(window_id).agg(F.max_by("file", F.struct("last_timestamp_ms", "first_timestamp_ms", "file")).alias("file"))
    return inside.unionByName(earlier.select(window_id, "file", F.lit("PREDECESSOR").alias("role")))


def verify_manifest(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Files by status: MISSING_SIDECAR, MISSING_FILE, SHA_MISMATCH, CORRUPT (parse errors) or OK, with the sums of parse errors.

    stored and found: file, sha256; found also parse_errors.
    """
    both = stored.select("file", F.col("sha256").alias("sha")).join(found.select("file", F.col("sha256").alias("now"), "parse_errors"), "file", "full_outer")
    status = (
        F.when(F.col("now").isNull(), "MISSING_FILE").when(F.col("sha").isNull(), "MISSING_SIDECAR").when(F.col("sha") != F.col("now"), "SHA_MISMATCH").when(F.col("parse_errors") > 0, "CORRUPT").otherwise("OK")
    )
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("files"), F.coalesce(F.sum("parse_errors"), F.lit(0)).alias("parse_errors"))


def sessions_of(journal: DataFrame, session: str, seq: str, kind: str, ms: str) -> DataFrame:
    """One row per session journal: its kind from the first entry, entries, first and last time."""
    return journal.groupBy(session).agg(F.min_by(kind, seq).alias("kind"), F.count("*").alias("entries"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))


def attempt_lines(lines: DataFrame, text: str, schema: str, longest: int) -> DataFrame:
    """Lines of an attempt log with status OK, OVERSIZE, INCOMPLETE (no JSON object) or DUPLICATE_KEY, and the parsed line of OK ones.

    A top-level key is written twice if the keys found by parsing are fewer than the key-like texts at depth one.
    """
    keys = F.json_object_keys(text)
    flat = F.regexp_replace(F.regexp_replace(F.substring(text, F.lit(2), F.length(text)), r"\[[^\[\]]*\]", "[]"), r"\{[^{}]*\}", "{}")
    written = F.regexp_count(flat, F.lit(r'"[^"]*"\s*:'))
    status = F.when(F.length(text) > longest, "OVERSIZE").when(keys.isNull() | ~F.col(text).rlike(r"\}\s*$"), "INCOMPLETE").when(written > F.array_size(F.array_distinct(keys)), "DUPLICATE_KEY").otherwise("OK")
    return lines.withColumn("status", status).withColumn("line", F.when(F.col("status") == "OK", F.from_json(text, schema)))


def order_telemetry(lines: DataFrame, text: str) -> DataFrame:
    """intent_id, status, events, filled: order events grouped to intents, in the order of seq.

    An intent is BAD_FIELD if a record has no number where one belongs, DUPLICATE_EVENT if an event id comes twice, else OK.
    """
    m = lines.select(F.from_json(text, "intent_id string, event_id string, seq bigint, event_type string, quantity string").alias("m")).select("m.*")
    m = m.withColumn("quantity", F.col("quantity").try_cast("double"))
    out = m.groupBy("intent_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "event_type"))).alias("events"), F.sum("quantity").alias("filled"), F.count_if(F.col("quantity").isNull() | F.col("seq").isNull()).alias("bad"),
        F.count("event_id").alias("n"), F.count_distinct("event_id").alias("ids"),
    )
    status = F.when(F.col("bad") > 0, "BAD_FIELD").when(F.col("ids") < F.col("n"), "DUPLICATE_EVENT").otherwise("OK")
    return out.select("intent_id", status.alias("status"), F.transform("events", lambda e: e["event_type"]).alias("events"), "filled")


def first_in_window(anchors: DataFrame, events: DataFrame, keys: list[str], anchor_id: str, t0: str, ms: str, width_ms: int) -> DataFrame:
    """anchor_id, n, first_ms of events with t0 < time <= t0 + width of the same keys, joined on time buckets of that width."""
    at = F.floor(F.col(t0) / width_ms)
    a = anchors.select(anchor_id, *keys, F.col(t0).alias("_t0"), F.explode(F.array(at, at + 1)).alias("_b"))
    b = events.select(*keys, F.col(ms).alias("_t"), F.floor(F.col(ms) / width_ms).alias("_b"))
    met = a.join(b, [*keys, "_b"]).where((F.col("_t") > F.col("_t0")) & (F.col("_t") <= F.col("_t0") + width_ms))
    found = met.groupBy(anchor_id).agg(F.count("*").alias("n"), F.min("_t").alias("first_ms"))
    return anchors.select(anchor_id).join(found, anchor_id, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def source_status(files: DataFrame, by: str) -> DataFrame:
    """Per group: PENDING if a file is still active, FINAL if all are verified, else NOT_CAPTURED; and the files of each class.

    files: by, file, state (ACTIVE, VERIFIED or anything else).
    """
    names = lambda state: F.array_sort(F.collect_list(F.when(F.col("state") == state, F.col("file"))))
    out = files.groupBy(by).agg(names("ACTIVE").alias("active"), names("VERIFIED").alias("verified"), F.count("file").alias("n"))
    status = F.when(F.size("active") > 0, "PENDING").when((F.col("n") > 0) & (F.size("verified") == F.col("n")), "FINAL").otherwise("NOT_CAPTURED")
    return out.select(by, status.alias("status"), F.size("active").alias("active"), F.size("verified").alias("verified"), (F.col("n") - F.size("active") - F.size("verified")).alias("other"))


def online_state(rows: DataFrame, key: str, order: list[str], label: str, past: int) -> DataFrame:
    """rows with seen and rate: number and mean of the last `past` labels of earlier rows of the key."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(-past, -1)
    return rows.withColumn("seen", F.count(label).over(by)).withColumn("rate", F.avg(label).over(by))
