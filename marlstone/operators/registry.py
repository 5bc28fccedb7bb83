"""Sources, jobs and access: small operators over dimension tables and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.files import normalised_identity, schema_name, view_of
from .folders import status_counts

PROTOCOLS = ("local", "webdav", "smb")
#: How often sources are scanned where nothing valid is said, and at most (minutes).
INTERVAL, LEAST_INTERVAL = 60, 5
MASK = "******"


def lookup(sources: DataFrame, key: str) -> DataFrame:
    """The source of an id, else of an alias; a blank key finds none."""
    hit = sources.where((F.col("id") == key) | (F.col("alias") == key)).where(F.lit(key.strip() != ""))
    return hit.orderBy(F.desc(F.col("id") == key), "id").limit(1)


def masked(secret: Column) -> Column:
    return F.when(F.coalesce(secret, F.lit("")) == "", F.lit("")).otherwise(F.lit("******"))


def latest_status(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Each job's last status and when it came; the later id wins at equal times."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return events.groupBy(key).agg(last.alias("x"), F.count("*").alias("n_events")).select(key, F.col("x.event_type").alias("status"), F.col("x.ts").alias("ts"), "n_events")


def due(sources: DataFrame, now: Column, busy: bool = False, least_minutes: int = 5) -> DataFrame:
    """The source whose scan is to start: the first in the registry's order (created, id) that was never scanned or waited its interval; none while any scan is ``busy``."""
    waited = F.unix_timestamp(now) - F.unix_timestamp("last_scan")
    ready = F.col("last_scan").isNull() | (waited >= 60 * F.greatest(F.lit(least_minutes), F.coalesce("interval_minutes", F.lit(60))))
    return sources.where("auto and enabled").where(ready & F.lit(not busy)).orderBy("created", "id").limit(1)


#: Paths that need no token.
OPEN_PATHS = ("/api/config/public", "/api/docs", "/api/openapi.json")


def allowed(path: Column, header: Column, tokens: tuple[str, ...] = ()) -> Column:
    """Whether a request may pass: any without tokens set; with the first token; the open paths, downloads, and all outside /api."""
    if not any(tokens):
        return F.lit(True)
    first = next(t for t in tokens if t)
    bearer = F.when(F.lower(header).startswith("bearer "), F.trim(F.call_function("substr", header, F.lit(8))))
    open_path = path.isin(*OPEN_PATHS) | ~path.startswith("/api") | (path.startswith("/api/files/") & path.endswith("/download"))
    return open_path | F.coalesce(bearer == F.lit(first), F.lit(False))


def problem(alias: Column, protocol: Column, access: Column, root: Column, url: Column) -> Column:
    """Why a source can't be registered; null if it can."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(~F.coalesce(alias, F.lit("")).rlike("^[A-Za-z0-9_-]{1,64}$"), "alias")
        .when(~F.coalesce(protocol, F.lit("")).isin(*PROTOCOLS), "protocol")
        .when(~F.coalesce(access, F.lit("")).isin("rw", "ro"), "access_mode")
        .when((protocol == "local") & blank(root), "root_path")
        .when((protocol == "webdav") & blank(url), "url")
    )


def interval(minutes: Column) -> Column:
    """A scan interval from what was given: a number, at least LEAST_INTERVAL; INTERVAL where it is none."""
    return F.greatest(F.lit(LEAST_INTERVAL), F.coalesce(minutes.try_cast("int"), F.lit(INTERVAL)))


def created(sources: DataFrame, new: DataFrame) -> DataFrame:
    """(new rows with interval, schema_name and problem): an alias that is taken, by a source or an earlier new row (order idx), is a problem as well."""
    taken = sources.select("alias", F.lit(True).alias("taken")).distinct()
    w = W.partitionBy("alias").orderBy("idx")
    rows = new.withColumn("again", F.row_number().over(w) > 1).join(taken, "alias", "left")
    wrong = problem(F.col("alias"), F.col("protocol"), F.col("access_mode"), F.col("root_path"), F.col("url"))
    identity = normalised_identity(F.col("protocol"), F.col("host"), F.col("port"), F.col("username"))
    out = rows.withColumns({"interval_minutes": interval(F.col("interval_minutes")), "schema_name": schema_name(identity), "problem": F.coalesce(wrong, F.when(F.col("taken") | F.col("again"), "alias exists"))})
    return out.drop("again", "taken")


def patched(sources: DataFrame, changes: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Sources with the fields of ``changes`` (source_id, fields) set; null means not given, a masked secret too, and other fields than ``allowed`` are ignored."""
    given = [c for c in changes.columns if c in allowed and c in sources.columns]
    rows = sources.join(changes.select("source_id", *(F.col(c).alias(f"new_{c}") for c in given)), "source_id", "left")
    new = lambda c: F.nullif(F.col(f"new_{c}"), F.lit(MASK)) if dict(sources.dtypes)[c] == "string" else F.col(f"new_{c}")
    out = rows.withColumns({c: F.coalesce(new(c), F.col(c)) for c in given})
    return out.select(*sources.columns)


def tenants(registry: DataFrame, asked: DataFrame) -> DataFrame:
    """The registry (protocol, host, port, username, schema_name, label) with the asked identities that it lacks; rows that are there stay as they are."""
    key = ["protocol", "host", "port", "username"]
    identity = normalised_identity(F.col("protocol"), F.col("host"), F.col("port"), F.col("username"))
    wanted = asked.select(identity.alias("i"), "label").select("i.*", schema_name(F.col("i")).alias("schema_name"), "label")
    fresh = wanted.groupBy(*key).agg(F.min("schema_name").alias("schema_name"), F.min("label").alias("label")).join(registry, key, "left_anti")
    return registry.select(*key, "schema_name", "label").unionByName(fresh)


def resolved_identity(asked: DataFrame, configured: DataFrame) -> DataFrame:
    """(root, identity) of each asked root: of its alias as configured, else of its web address, else local; an unknown alias is an error."""
    known = configured.select(F.col("alias"), normalised_identity(F.col("protocol"), F.col("host"), F.col("port"), F.col("username")).alias("of_alias"))
    web = F.col("root").rlike("^https?://")
    host, port = F.regexp_extract("root", "^https?://(?:[^/@]*@)?([^/:]+)", 1), F.regexp_extract("root", "^https?://(?:[^/@]*@)?[^/:]+:([0-9]+)", 1)
    default = F.when(F.col("root").startswith("https"), "443").otherwise("80")
    of_web = normalised_identity(F.lit("webdav"), host, F.coalesce(F.nullif(port, F.lit("")), default), F.coalesce("user", F.lit("")))
    local = normalised_identity(F.lit("local"), F.lit("local"), F.lit("0"), F.lit(""))
    unknown = F.raise_error(F.concat(F.lit("no such alias: "), "alias"))
    rows = asked.join(known, "alias", "left")
    pick = lambda c: F.when(F.coalesce("alias", F.lit("")) != "", F.when(F.col("of_alias").isNotNull(), F.col("of_alias")[c]).otherwise(unknown.cast(dict(protocol="string", host="string", port="int", username="string")[c]))).when(web, of_web[c]).otherwise(local[c])
    return rows.select("root", *(pick(c).alias(c) for c in ("protocol", "host", "port", "username")))


def options(registry: DataFrame, resources: DataFrame) -> DataFrame:
    """(schema_name, label, resources, ok, stale, missing): every tenant with its counts; null where it has none."""
    plain = F.concat("protocol", F.lit("://"), "host", F.lit(":"), F.col("port").cast("string"), F.when(F.col("username") != "", F.concat(F.lit(" ("), "username", F.lit(")"))).otherwise(""))
    counts = status_counts(resources, "schema_name").withColumnRenamed("total", "resources")
    return registry.select("schema_name", F.coalesce(F.nullif("label", F.lit("")), plain).alias("label")).join(counts, "schema_name", "left")


def fetched(asked: DataFrame, resources: DataFrame) -> DataFrame:
    """(resource_id, source_id, rel_path, problem): a resource asked for by its source; one of another source is as good as none."""
    rows = asked.join(resources.select("resource_id", F.col("source_id").alias("owner"), "rel_path"), "resource_id", "left")
    fine = F.col("rel_path").isNotNull() & (F.coalesce("owner", F.lit("")).isin("") | (F.lower("owner") == F.lower("source_id")))
    return rows.select("resource_id", "source_id", F.when(fine, F.col("rel_path")).alias("rel_path"), F.when(~fine, "not found").alias("problem"))


def document_meta(resources: DataFrame, full_text: bool = False, most_bytes: int = 8 << 20) -> DataFrame:
    """Metadata of documents with their full text if asked, their bytes in base64 up to a size, and their address."""
    address = F.concat(F.lit("/api/files/"), "resource_id", F.lit("/download?src="), "source_id")
    data = F.when(F.col("size_bytes") <= most_bytes, F.translate(F.base64(F.col("text").cast("binary")), "\r\n", ""))
    return resources.select("resource_id", "rel_path", "summary", "size_bytes", *(["text"] if full_text else []), data.alias("data"), address.alias("url"))


def preview(ext: Column, size: Column, cap: int = 512 * 1024) -> Column:
    """(viewable, truncated, reason) of a file in a browser: its kind, whether a text is cut at the cap, or that the type has no view."""
    kind = view_of(ext)
    return F.struct(kind.alias("viewable"), F.when(kind == "text", size > cap).otherwise(False).alias("truncated"), F.when(kind.isNull(), "unsupported_type").alias("reason"))


def roots_status(scans: DataFrame) -> DataFrame:
    """One row a root (root, status) of its files' states, and one for all of them (root null)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return scans.rollup("root").agg(F.count("*").alias("total"), n("valid"), n("missing"), n("stale"))


def from_json_records(lines: Column, schema: str) -> Column:
    """A record of JSON text: what is missing or of another type is null; what is no object is null altogether."""
    return F.when(F.ltrim(lines).startswith("{"), F.from_json(lines, schema, {"mode": "PERMISSIVE"}))


#: What is set where a configuration says nothing.
DEFAULTS = {
    "enabled": "false", "target_chars": "800", "limit_chars": "1200", "overlap_ratio": "0.12", "direct_return": "false", "direct_return_similarity": "0.9",
    "max_context_chars": "5000", "top_n": "5", "min_score": "0.6", "chunker_version": "1", "no_hit_mode": "designated",
}


def configured(settings: DataFrame, spark) -> DataFrame:
    """(key, value): the defaults with what ``settings`` (key, value) says; unknown keys stay, blank values count as not said."""
    base = spark.createDataFrame(list(DEFAULTS.items()), "key string, standard string")
    said = settings.where("coalesce(trim(value), '') <> ''").groupBy("key").agg(F.max("value").alias("value"))
    return base.join(said, "key", "full_outer").select("key", F.coalesce("value", "standard").alias("value"))
